"""BPE, language identification, decontamination, personal data and chat formatting."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronolith.llm import bpe, chat_format, decontaminate, language_id, pii, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
VOCABULARY = bpe.packed_file(PATH)

PIECES = st.sampled_from(["the", " thing", "in", "é", " ", "  ", "\n", "\t", "'ll", "123", "<|endoftext|>", "漢", "😀", "aaaa", "\x1c", "\x85", " ", "!!", "​", "Ǆ"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PIECES, max_size=25).map("".join)))
def test_bpe_is_the_library_s(text):
    text = text.encode("utf-8", "ignore").decode()
    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    got = bpe.coder_of(VOCABULARY).encode(text)
    assert got == want
    assert bpe.decode(bpe.table_of(VOCABULARY), got) == TOKENIZER.decode(want, skip_special_tokens=False)


def test_bpe_of_long_words_and_forgotten_ones(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    r = random.Random(3)
    texts = ["x" * 3000, "".join(r.choice("ab") for _ in range(3000)), *(" ".join("".join(r.choice("inthe") for _ in range(6)) for _ in range(30)) for _ in range(8))]
    coder = bpe.coder_of(VOCABULARY)
    assert [y for t in texts for y in coder.encode_batch([t])] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, "a b", [9]), (2, None, None), (2, None, None)], "doc_id long, text string, ids array<int>")
    coded = bpe.bpe_decode(bpe.bpe_encode(df, VOCABULARY), VOCABULARY)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id, r.ids, r.decoded) for r in coded.collect()) == [(1, TOKENIZER.encode("a b").ids, "a b"), (2, [], ""), (2, [], "")]
    assert bpe.bpe_round_trip(df.limit(0), VOCABULARY).count() == 0


def test_bpe_query(spark, small):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        ids = TOKENIZER.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(TOKENIZER.decode(ids, skip_special_tokens=False)))


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred string"
    rows = [(i, "the house and the garden are here", "en", "x", "y") for i in range(1, 9)] + [(i, "das haus und der garten sind hier", "de", "x", "y") for i in range(9, 18)]
    rows += [(50, None, "en", "", ""), (51, "123 ...", None, "", ""), (52, "", None, "", ""), (None, "der garten und das haus", None, "", ""), (53, "the garden", None, "", ""), (53, "the garden", None, "", "")]
    df = spark.createDataFrame(rows, schema)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.language_predictions(df).collect()]
    assert [g[1:] for g in got if g[0] in (50, 51, 52)] == [("und", 0.0)] * 3
    assert [g[1] for g in got if g[0] == 53] == ["en", "en"] and [g[1] for g in got if g[0] is None] == ["de"]
    assert language_id.keep_identified(df).columns == df.columns and language_id.keep_identified(df).count() == len(rows) - 3
    kept = {(r.doc_id, r.text): (r.score, r.lang_pred) for r in language_id.keep_identified(df).collect()}
    assert kept[1, rows[0][1]] == ("x", "y") and kept[53, "the garden"] == ("", "")  # the rows' own columns of these names
    with pytest.raises(ValueError):
        language_id.identify(df, language_id.LanguageModel.fit([], []))
    assert {r.lang_pred for r in language_id.language_predictions(df.where("lang IS NULL")).collect()} == {"und"}
    assert language_id.language_predictions(df.limit(0)).count() == 0


def test_fitting_sample_is_bounded(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 1500) AS text", "IF(id % 3 = 0, 'en', 'de') AS lang").unionAll(spark.sql("SELECT 1L, 'same', 'fr' FROM range(500)"))
    texts = {}

    def fit(found, langs):
        for t, x in zip(found, langs, strict=True):
            texts.setdefault(x, []).append(t)

    old, language_id.LanguageModel.fit = language_id.LanguageModel.fit, fit
    try:
        language_id.fit_language_model(df, 50)
    finally:
        language_id.LanguageModel.fit = old
    assert len(texts["en"]) == len(texts["de"]) == 50 and texts["fr"] == ["same"]


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (p != c)))
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=1, max_size=70), st.text("ab ", max_size=90))
def test_myers_distance(pattern, text):
    bits = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    assert decontaminate.best_end(bits, len(pattern), text)[0] == slow_distance(pattern, text)


def test_decontamination_against_brute_force(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(40)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.randint(5, 14))) for i in range(12)] + [(12, "too short"), (13, None), (14, text(3))]
    items.append((15, items[0][1]))

    def spoiled(t):
        t = list(t)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], ["z"], [t[k], "y"]])
        return "".join(t)

    docs = [(d, text(r.randint(0, 30)) + " " + spoiled(r.choice(items[:12])[1]).upper() + "\n " + text(5)) for d in range(60)] + [(60, None), (61, ""), (None, items[1][1]), (0, items[2][1])]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, item in items:
            norm = decontaminate.normal_text(item)
            if len(norm.split()) >= 5 and (k := slow_distance(norm, decontaminate.normal_text(t))) <= int(len(norm) * 0.05):
                want.add((d, i, k))
    got = decontaminate.find_leaks(df, bench)
    assert {(x.doc_id, x.item_id, x.distance) for x in got.collect()} == want and len(want) > 20
    blocks = decontaminate.find_leaks(df, bench, block_chars=200)
    assert {(x.doc_id, x.item_id, x.distance) for x in blocks.collect()} == want
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not any(w[0] == d and slow_distance(decontaminate.normal_text(dict(items)[w[1]]), decontaminate.normal_text(t)) == w[2] for w in want) for d, t in docs)
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_repetitive_items_edited_at_their_beginning():
    r = random.Random(3)
    found = 0
    for _ in range(150):
        refrain = " ".join(r.choice(["true", "false"]) for _ in range(r.randint(2, 6)))
        item = decontaminate.normal_text(f"{refrain} " * r.randint(4, 8) + r.choice(["", "which of the statements above hold"]))
        errors = int(len(item) * 0.05)
        spoiled = list(item)
        for _ in range(r.randint(1, errors + 1)):
            spoiled[r.randrange(len(item) // 2)] = "z"
        text = "some words before " + "".join(spoiled) + " and after"
        distance = slow_distance(item, text)
        want = [(7, distance, 1)] if distance <= errors else []
        assert decontaminate.ItemMatcher([(7, item)]).matches(text) == want
        found += len(want)
    assert found > 50
    twice = decontaminate.ItemMatcher([(7, item)]).matches(f"{item} and {item}")
    assert twice == [(7, 0, 2)]


def test_items_of_few_words_but_many_characters(spark):
    items = [(1, "下列哪一项是植物光合作用的主要产物"), (2, "electroencephalographically monitored thermoregulation"), (3, "yes"), (4, " "), (5, "the right one")]
    docs = [(k, f"before {t} after") for k, t in items] + [(6, "下列哪一项是植物呼吸作用的主要产物")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(x) for x in decontaminate.find_leaks(df, bench).collect()) == [(1, 1, 0, 1), (2, 2, 0, 1)]
    assert sorted(x.doc_id for x in decontaminate.drop_leaks(df, bench).collect()) == [3, 4, 5, 6]
    assert sorted(tuple(x) for x in decontaminate.find_leaks(df, bench, min_words=0, min_bytes=0).collect()) == [(1, 1, 0, 1), (2, 2, 0, 1), (3, 3, 0, 1), (5, 5, 0, 1)]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_of_made_texts(spark):
    r = random.Random(6)
    bits = ["a@b.c", "x.y-z@mail.example.com", "@", ".", "-", " ", "  ", "é😀", "4111 1111 1111 1111", "4111-1111-1111-1111", "79927398713", "123456789012345678901234", "1.2.3.4", "256.1.1.1", "0255.1.1.1", "1.2.3.4.5.6.7.8", "+1 (234) 555-1234", "+12345678901234567890", "+1", "7", "00", "(", ")", "", "\n", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "%d@e.f"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))) for i in range(500)]
    rows += [(900, "1 " * 5000), (901, "a" * 50_000), (902, "a@" + "b." * 5000), (903, None), (904, ""), (905, "1.2.3.4 " * 700), (906, "9" * 30_000), (907, "+1" * 3000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, found string")
    got = {x.doc_id: x for x in pii.span_digests(pii.find_spans(df)).collect()}
    for i, t in rows:
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (i, t[:200], want, got[i].spans[:300])
        kept = [s for s in got[i].spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")]
        assert ",".join(kept) == want
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[2] == k for s in base_spans(t or "")) for k in ("email", "ip", "card", "phone")]
    assert all(s.split(":")[0] in pii.ORDER for x in got.values() for s in x.spans.split(",") if s)
    assert pii.span_digests(pii.find_spans(df.limit(0))).count() == 0


def test_reliabilities_tell_good_labelers_from_noise():
    r = random.Random(5)
    counts = {}
    for _ in range(4000):
        true = r.random() < 0.4
        say = lambda p: ("2" if true else "0") if r.random() < p else ("0" if true else "2")  # noqa: B023, E731
        votes = say(0.95) + say(0.9) + say(0.5) + "1" + "1" + say(0.9)
        counts[votes] = counts.get(votes, 0) + 1
    model = pii.LabelModel(counts)
    worth = [model.reliability[j][1][2] - model.reliability[j][0][2] for j in (0, 1, 2, 5)]
    assert min(worth[0], worth[1], worth[3]) > 0.5 > 0.25 > abs(worth[2]) and abs(model.share - 0.4) < 0.05
    own = pii.SpanClassifier([(v + "000", model.probability(v), n) for v, n in counts.items()])
    assert own.score("222112000") > 0 > own.score("002110000")


def iban(r, country="DE", digits=18):
    bban = "".join(r.choice("0123456789") for _ in range(digits))
    number = int(bban + "".join(str(ord(c) - 55) for c in country) + "00")
    return f"{country}{98 - number % 97:02d}{bban}"


def labelled_texts(r):
    """(text, kind or None, span): texts with one thing that is personal data of a kind, or only looks like it."""
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    mixed, hexes = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789", "0123456789abcdef"
    words = lambda: " ".join(r.choice(["we", "see", "that", "all", "of", "it", "went", "well", "und", "dann", "pour", "cela", "entonces"]) for _ in range(r.randint(1, 6)))
    ssn = lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
    given, family = r.choice(["Anna", "Peter", "Carlos", "Sophie", "Linda", "Stefan"]), r.choice(["Müller", "Smith", "García", "Johansson", "Dubois", "Brown"])
    made = r.choice([
        lambda: ("secret", 'password = "{}"', some(mixed, r.randint(20, 60)) + "7a"), lambda: ("secret", "api_key: {}", some(hexes, 40) + "a1"), lambda: ("secret", "use {} for it", "ghp_" + some(mixed, 36) + "4"),
        lambda: ("secret", "token={}", some(mixed, r.randint(200, 400)) + "0z9"), lambda: ("secret", "Authorization: Bearer {}", some(mixed, 48) + "q8q"),
        lambda: (None, "commit {}", some(hexes, 40)), lambda: (None, "request {} failed", "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12))), lambda: (None, "see /{} there", "a-long-page-title-of-2024-05"),
        lambda: (None, "md5 {}", some(hexes, 32)), lambda: (None, "model {}", "SERIES" + some("0123456789", 12)), lambda: (None, "the file {}", "backup_database_daily_20240611"),
        lambda: ("ssn", "SSN: {}", ssn()), lambda: ("ssn", "his social security number is {}", ssn()), lambda: ("ssn", "ssn {},", ssn().replace("-", " ")), lambda: ("ssn", "it says {}", ssn()),
        lambda: (None, "part {}", ssn()), lambda: (None, "order no. {}", ssn()), lambda: (None, "number {}", "000" + ssn()[3:]), lambda: (None, "ISBN {}", ssn()),
        lambda: ("iban", "IBAN {}", iban(r)), lambda: ("iban", "Konto: {}.", iban(r, "FR", 23)), lambda: ("iban", "send it to {}", iban(r, "ES", 20)), lambda: ("iban", "IBAN: {}", re.sub("(.{4})(?=.)", r"\1 ", iban(r, "GB", 18))),
        lambda: (None, "product {}", "AB12" + some("0123456789ABCDEF", 14)), lambda: (None, "key {}", iban(r)[:-1] + "X"), lambda: (None, "article {}", "XK" + some("0123456789", 15)),
        lambda: ("name", "Mr. {}", f"{given} {family}"), lambda: ("name", "talked to {} again", f"{given} {family}"), lambda: ("name", "my name is {}.", f"{given} {family}"), lambda: ("name", "signed {}", f"{given} B. {family}"),
        lambda: (None, "in {}", "New York"), lambda: (None, "by the {}", "General Public License"), lambda: (None, "at {}", "Columbia University"), lambda: (None, "on {}", "Monday Morning"), lambda: (None, "the {}", "Deutsche Bank"), lambda: (None, "the {}", "Green Party"),
    ])()
    kind, context, span = made
    before = words() + r.choice([" ", ". ", ", ", "\n"])
    text = before + context.format(span) + r.choice([" ", ", ", "\n", " – "]) + words()
    return text, kind, (text.index(span), text.index(span) + len(span))


def test_labelled_spans_of_the_added_kinds(spark):
    r = random.Random(21)
    rows = [labelled_texts(r) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: {(s.kind, s.start, s.stop) for s in x.spans if not s.base} for x in pii.find_spans(df).collect()}
    rejected = sum(len(x.found) for x in pii.candidates(df).collect()) - sum(len(s) for s in got.values())
    assert rejected > 300
    for kind in ("secret", "ssn", "iban", "name"):
        want = {(i, *at) for i, (_, k, at) in enumerate(rows) if k == kind}
        found = {(i, s[1], s[2]) for i, own in got.items() for s in own if s[0] == kind}
        right = len(want & found)
        print(kind, right, len(want), len(found), [rows[i][0] for i, *_ in sorted(want ^ found)][:12])
        assert right >= 0.9 * len(want) and right >= 0.9 * len(found), kind


def test_a_lone_candidate_is_judged_by_its_context(spark):
    texts = ["part 123-45-6789", "SSN 123-45-6789", "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "IBAN DE89370400440532013000", "Mr. John Smith", "in New York", "token = " + "aB3" * 500]
    for text, kinds in zip(texts, [[], ["ssn"], [], ["secret"], ["iban"], ["name"], [], ["secret"]], strict=True):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert [s.kind for s in pii.find_spans(df).collect()[0].spans] == kinds, text


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\", "[", "<", "\\[", "<\\", "[\\", "[ROLE]x[AS]y[/ROLE]", "", "<<SYS>>", "é😀\n"]
    r = random.Random(9)
    rows = [(c, t, r.choice(["system", "user", "assistant", "tool", None, "[AS]"]), r.choice([*hostile, "".join(r.choice(hostile) for _ in range(5)), None]), "z") for c in range(30) for t in range(r.randint(1, 6))]
    rows += [(99, 0, "user", "hi", "z"), (99, 0, "user", "hi", "z"), (99, None, "assistant", "first", "z"), (None, 1, "user", "q", "z"), (None, 2, "assistant", "a", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {x.conv_id: x for x in chat_format.read_conversations(chat_format.format_conversations(df)).collect()}
    groups = {}
    for c, t, role, text, _ in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[None].valid and not got[99].valid
    assert chat_format.format_conversations(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("<[\\/s>INST] ]x", max_size=40))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat_format.escape(text)
    assert chat_format.unescape(hidden) == text
    assert not any(m in hidden for role in chat_format.DEFAULT.roles.values() for m in role[:2] if m.strip())
    assert not re.search(r"[\[<](?!\\)", hidden)


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool"])
def test_turns_are_read_back(role):
    line = "".join(s for s, _ in chat_format.turn_segments(role, "</s> [/INST] \\"))
    assert chat_format.read_turn(line + "[INST] next")[:2] == (role, "</s> [/INST] \\")
