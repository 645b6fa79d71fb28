"""Language identification by hierarchical discrimination.

Linear support vector machines first tell the language's family, then, within the family, one-versus-one machines tell the
closely related languages apart. Features are pairs of neighbouring characters of the lower-cased text (bytes folded to
64 classes), as shares of all its pairs, each scaled by its usual size; a machine's margin is then a sum over the
text of one weight per pair, so that texts of any length are read whole in bounded memory.

Machines are fitted by dual coordinate descent on a sample: up to `per_language` labelled rows of each language, those of
smallest hash of doc_id and text, where the rows used for learning are those whose crc32(doc_id) mod 5 isn't 0. This is the
one sample, taken in one pass for all languages; prediction reads all rows.

Defined results: a null text, or one without a letter, is `und` with score 0. Rows with a null language are never
learned from but predicted. If nothing can be learned from (no labelled rows), all is `und`; with one language, that is
predicted. A null doc_id counts as not held out. Repeated rows are predicted each, and learned from once; an empty table gives
no rows. `identify` adds columns of given names, which the rows must not have; `keep_identified` reads no column but doc_id,
lang and text, and returns all as they are.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, schema_with, text_slices

#: Families of languages by their two-letter codes. Languages that aren't listed are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr sl bs",
    "baltic": "lt lv",
    "finnic": "fi et",
    "turkic": "tr az kk uz tk",
    "semitic": "ar he mt am",
    "indic": "hi ur bn mr gu pa ne si",
    "malayic": "id ms",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
#: Bound of the fitting sample: rows of each language.
PER_LANGUAGE = 400
CLASSES = 64


def _folded() -> np.ndarray:
    """The class of each byte: 0 for all that's no letter or digit, 1 digits, 2-27 letters, the others for bytes of non-ASCII letters."""
    out = np.zeros(256, np.uint16)
    out[48:58] = 1
    out[97:123] = np.arange(2, 28)
    out[128:192] = 28 + np.arange(64) % 32
    out[192:] = 60 + np.arange(64) // 16
    return out


FOLD = _folded()


def pairs_of(text: str) -> np.ndarray:
    """Codes of the neighbouring pairs of the text, as if a space stood before and after it."""
    folded = FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    codes = folded[:-1] * CLASSES + folded[1:]
    return codes[codes != 0]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Weights of a linear machine with hinge loss, by dual coordinate descent; y is 1 or -1. The last column of x is the bias."""
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    norm = np.einsum("ij,ij->i", x, x) + 1e-12
    share = {s: len(y) / (2.0 * max(1, (y == s).sum())) for s in (1, -1)}
    most = np.array([c * share[int(s)] for s in y])
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(x)):
            step = (1 - y[i] * (x[i] @ w)) / norm[i]
            new = min(max(alpha[i] + step, 0.0), most[i])
            if d := new - alpha[i]:
                w += d * y[i] * x[i]
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w


@dataclass
class LanguageModel:
    """Families, their languages, and a weight table with a column for each machine (the last row has the biases)."""

    families: dict[str, list[str]]
    machines: list[tuple[str, str, str]]  # level, positive, negative
    weights: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> LanguageModel:
        known = sorted(set(langs))
        families: dict[str, list[str]] = {}
        for lang in known:
            families.setdefault(FAMILY.get(lang, lang), []).append(lang)
        shares = np.zeros((len(texts), CLASSES * CLASSES + 1), np.float32)
        for row, text in zip(shares, texts, strict=True):
            codes = pairs_of(text)
            row[:-1] = np.bincount(codes, minlength=CLASSES * CLASSES) / max(1, len(codes))
        scale = 1 / np.sqrt(shares[:, :-1].mean(axis=0) + 1e-4) if len(texts) else np.ones(CLASSES * CLASSES)
        shares[:, :-1] *= scale
        shares[:, -1] = 1
        family = np.array([FAMILY.get(x, x) for x in langs])
        lang = np.array(langs)
        machines, columns = [], []
        for level, names, of in (("", sorted(families), family), *((f, own, lang) for f, own in families.items())):
            for a, b in itertools.combinations(names, 2):
                rows = (of == a) | (of == b)
                columns.append(fit_svm(shares[rows], np.where(of[rows] == a, 1, -1)))
                machines.append((level, a, b))
        weights = np.stack(columns, axis=1) if columns else np.zeros((CLASSES * CLASSES + 1, 0))
        weights[:-1] *= np.asarray(scale)[:, None]
        return cls(families, machines, weights.astype(np.float32))

    def _vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The name with most one-versus-one wins (then the largest sum of margins), and its least probability against another."""
        if len(names) == 1:
            return names[0], 1.0
        won: dict[str, list[float]] = {n: [] for n in names}
        for (at, a, b), m in zip(self.machines, margins, strict=True):
            if at == level and a in won and b in won:
                won[a].append(float(m))
                won[b].append(-float(m))
        best = max(names, key=lambda n: (sum(m > 0 for m in won[n]), sum(won[n])))
        return best, 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * min(won[best])))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        codes, total = pairs_of(text), np.zeros(self.weights.shape[1])
        for a in range(0, len(codes), 1 << 18):
            total += self.weights[codes[a : a + (1 << 18)]].sum(axis=0, dtype=np.float64)
        margins = total / max(1, len(codes)) + self.weights[-1]
        family, p = self._vote("", sorted(self.families), margins)
        lang, q = self._vote(family, self.families[family], margins)
        return lang, p * q


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_language_model(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from `per_language` labelled rows of each language at most (see the module's text)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out()).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)).alias("h"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    # only about twice as many texts of each language go into the sort
    below = [x for lang, n in sizes for x in (F.lit(lang), F.lit(int(min(1.0, 2 * per_language / max(1, n)) * (1 << 31))))]
    some = labelled.where(F.col("h") < F.element_at(F.create_map(*below), F.col("lang"))) if below else labelled.limit(0)
    once = some.groupBy("lang", "h").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    found = sorted((r.lang, r.nth, r.text) for r in once.withColumn("nth", nth).where(F.col("nth") <= per_language).collect())
    return LanguageModel.fit([r[2] for r in found], [r[0] for r in found])


def _predicted(docs: DataFrame, model: LanguageModel, text_col: str, whole: bool, schema) -> DataFrame:
    """Rows with the prediction and its score if `whole`, else those of a known language without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = batch.column(batch.num_columns - 1).to_pylist(), batch.num_columns - 1
            for a, b in text_slices(texts):
                found = [model.predict(x) for x in texts[a:b]]
                kept = [batch.column(i).slice(a, b - a) for i in range(columns)]
                if whole:
                    more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                    yield pa.RecordBatch.from_arrays([*kept, *more], schema.names)
                else:
                    yield pa.RecordBatch.from_arrays(kept, schema.names).filter(pa.array([x[0] != UNKNOWN for x in found], pa.bool_()))

    return docs.withColumn(free_name(docs, "read"), F.col(text_col)).mapInArrow(run, schema)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """`docs` with the predicted language and its score."""
    if {lang_out.lower(), score_out.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the rows have a column {lang_out} or {score_out} already")
    return _predicted(docs, model, text_col, True, schema_with(docs, **{lang_out: "string", score_out: "double"}))


def language_predictions(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    model = fit_language_model(docs, per_language)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", _held_out())
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language can be told, with their own columns."""
    return _predicted(docs, fit_language_model(docs), "text", False, docs.schema)
