r"""Personal data by weak-supervision aggregation, in DataFrame operations alone.

Candidate spans of each kind come from one loose pattern a kind, which also takes in much that is no personal data (hashes,
ids, part numbers, capitalised phrases). Six labelers a kind each vote for, against or not at all: a strict pattern, a gazetteer (given names,
family names, places and organisations, IBAN countries, prefixes of issued numbers, parts of random strings), words
before the span, what stands around it, contrary context, and a check (Luhn, mod 97, valid ranges). Expectation-maximisation over
the counts of vote patterns estimates, for each kind, each labeler's reliability under either truth and so every
pattern's probability; weak priors on the reliabilities keep the two truths apart where a corpus has few candidates. With
these probabilities as soft labels a logistic classifier of each kind is trained on the votes and the span's shape (length,
share of digits, case), and decides each candidate, so that it rejects as well as accepts. Spans of the base definition
stay whatever it says. What comes to the driver is a table of vote and shape patterns, whose size has a bound that doesn't
depend on the texts (`PATTERNS` rows), so that the estimation itself runs there, in plain arithmetic.

Positions are code points, the end exclusive. Spark gives the matches of a pattern, and splitting by the same pattern gives
what stands between them; running sums of both lengths are the positions. Patterns are written so that
no input makes them slow or deep: repeated groups are turned into character classes by first replacing separators inside a run
by a private character, which leaves positions as they are.

Defined results: a null text counts as empty and has no spans. Spans of any length are found. Repeated rows are read each; an
empty table gives no rows. A private-use character that stands in a text never counts as a separator. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: A separator inside a run of digits or of a domain's labels.
MARK = chr(0xE000)
EMAIL_CHARS = rf"A-Za-z0-9._%+{MARK}-"


@dataclass(frozen=True)
class Kind:
    """A kind of span. `joined` is a pattern whose single characters become MARK before `pattern` is looked for; `valid` and the labelers are SQL over a candidate c: its match m, and what stands before (pre) and after it (post).

    A labeler with a pair has conditions for a vote for and against; before and contrary are words in front of the span.
    """

    name: str
    guard: str
    pattern: str
    valid: str = "true"
    base: bool = False
    joined: str = ""
    strict: tuple[str, str] = ("", "")
    gazetteer: tuple[str, str] = ("", "")
    before: str = ""
    around: tuple[str, str] = ("", "c.pre rlike '[A-Za-z0-9]$' OR c.post rlike '^[A-Za-z0-9]'")
    contrary: str = "version|release|build|isbn|order no|order number|part|serial|model|invoice|item|sku|page|ticket|case"
    check: tuple[str, str] = ("", "")


#: Names, words and codes that the gazetteers know.
GIVEN_NAMES = (
    "Adam Alan Albert Alex Alexander Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anita Ann Anna Anne Anthony Antonio Barbara Ben Benjamin Bernd Brian Bruno Camille Carl Carla Carlos Carmen Carol "
    "Caroline Catherine Charles Charlotte Chloe Chris Christian Christine Christopher Clara Claire Claudia Daniel David Diana Diego Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Felix Fernando "
    "Florian Francisco Frank Franz Gabriel George Grace Greta Hannah Hans Heather Helen Helga Henry Ian Ingrid Isabel Jack Jacob James Jan Jane Janet Javier Jean Jennifer Jens Jessica Joan Joe Johann Johannes "
    "John Jonathan Jorge Joseph Juan Julia Julie Karen Karl Katherine Kevin Klaus Laura Lena Leo Linda Lisa Louis Louise Lucas Lucy Luis Manuel Marcus Margaret Maria Marie Mark Martin Mary Matthew Michael Monika "
    "Nancy Nicolas Nicole Nina Olivia Oscar Otto Pablo Patricia Patrick Paul Paula Pedro Peter Petra Philip Pierre Rachel Ralf Rebecca Richard Robert Roger Rosa Ruth Sabine Sandra Sara Sarah Scott Sofia Sophie "
    "Stefan Stephen Steven Susan Thomas Tim Ursula Victor Victoria Walter Werner William Wolfgang Yvonne"
).split()
FAMILY_NAMES = (
    "Smith Jones Taylor Brown Williams Wilson Johnson Davies Robinson Wright Thompson Evans Walker White Roberts Green Hall Wood Jackson Clarke Miller Davis Moore Anderson Clark Lewis Young Allen King Scott Hill Adams Baker Nelson "
    "Campbell Mitchell Carter Turner Parker Collins Edwards Stewart Morris Murphy Cook Rogers Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Neumann Schwarz Braun Krüger "
    "Martin Bernard Dubois Durand Leroy Moreau Simon Laurent Lefebvre Michel García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Díaz Garcia Lopez Perez Romero Torres Ruiz Silva Santos Rossi Ferrari Novak Kowalski"
).split()
NO_GIVEN_NAMES = (
    "The This That These Those A An In On At Of For From With And But Or If When While After Before Our Your Their His Her My Its New Old Great United North South East West Northern Southern Eastern Western San Santa Saint Los Las El La Le "
    "Les Der Die Das Ein Eine Und Und Upper Lower Mount Lake River Fort Port Cape Gulf General Public National Royal Free Open Central International World First Second Third Chapter Section Figure Table Part January February March April May "
    "June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Deutsche Bank University Dear Terms Privacy All Rights Creative Apache"
).split()
NO_FAMILY_NAMES = (
    "University College School Institute Street Road Avenue Lane Square Park City Town County State States River Lake Mountain Mountains Sea Ocean Island Islands Bay Bridge Station Airport Hotel Museum Library Church Hospital Bank Company Inc Corp "
    "Corporation Ltd GmbH Group Foundation Association Society Council Committee Department Ministry Office Agency Court Party Union Kingdom Republic League Club Team Cup War Act Law Code License Policy Conditions Service Services Software System Systems "
    "Day Week Year Times Post News Press Book Review Journal Version Edition Chapter Reserved Commons York Francisco Angeles Zealand America Africa Asia Europe"
).split()
FAMILY_ENDINGS = "son|sen|mann|berg|stein|ski|sky|ova|elli|oux|ez|dez|ham|worth|ington"
IBAN_LENGTHS = "AD24 AT20 BE16 BG22 CH21 CY28 CZ24 DE22 DK18 EE20 ES24 FI18 FR27 GB22 GR27 HR21 HU28 IE22 IS26 IT27 LI21 LT20 LU20 LV21 MC27 MT31 NL18 NO15 PL28 PT25 RO24 SE24 SI19 SK24 SM27 TR26".split()
SECRET_PREFIXES = "sk-|sk_|pk_|rk_|gh[opsur]_|glpat-|xox[abprs]-|AKIA|ASIA|AIza|eyJ|npm_|hf_|SG"

DIGITS = "regexp_replace(c.m, '[^0-9]', '')"
DIGIT = f"cast(substr({DIGITS}, -i, 1) AS int)"
LUHN = f"aggregate(sequence(1, length({DIGITS})), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN {DIGIT} WHEN {DIGIT} < 5 THEN 2 * {DIGIT} ELSE 2 * {DIGIT} - 9 END) % 10 = 0"
OCTETS = "forall(split(c.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)"
PLAIN = f"replace(c.m, '{MARK}', '')"
#: The remainder of an account number by 97, a character at a time: letters count as 10 to 35.
MOD97 = (
    f"aggregate(filter(split(concat(substr({PLAIN}, 5), left({PLAIN}, 4)), ''), x -> x <> ''), 0, (s, x) -> "
    "CASE WHEN x BETWEEN '0' AND '9' THEN (s * 10 + cast(x AS int)) % 97 ELSE (s * 100 + ascii(x) - 55) % 97 END) = 1"
)
#: Runs of digits and of other characters: random strings change between them often, words and dates seldom.
RUNS = "length(regexp_replace(regexp_replace(c.m, '[0-9]+', '0'), '[^0-9]+', 'a'))"


def _word_in(place: str, words: list[str]) -> str:
    """SQL: whether the first or last word of a match is one of some words."""
    return f"regexp_extract(c.m, '{'^[^ ]+' if place == 'first' else '[^ ]+$'}', 0) IN ({', '.join(map(repr, words))})"


#: The base kinds come first, in the order that ties of start are listed in.
KINDS = (
    Kind("email", "[@]", rf"(?:(?<![{EMAIL_CHARS}])|\G)[{EMAIL_CHARS}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++", base=True, joined=r"(?<=[A-Za-z0-9-])[.](?=[A-Za-z0-9-])", strict=(f"c.m rlike '[{MARK}.][A-Za-z]{{2,}}$'", f"NOT c.m rlike '[{MARK}.][A-Za-z]{{2,}}$'"), gazetteer=(f"c.m rlike '(?i)[{MARK}.](com|org|net|edu|gov|io|de|fr|es|uk|info)$'", ""), before="mail|contact|write|reply", around=("", "")),
    Kind("ip", "[0-9][.][0-9]", r"(?<![0-9])[0-9]++([.][0-9]++)([.][0-9]++)([.][0-9]++)", OCTETS, True, strict=("NOT c.m rlike '(^|[.])0[0-9]'", "c.m rlike '(^|[.])0[0-9]'"), gazetteer=("c.m rlike '^(10|127|192|172)[.]'", ""), before="ip|address|host|server|from", around=("", "c.post rlike '^[.][0-9]'")),
    Kind("card", "[0-9]", rf"(?<![0-9{MARK}])[0-9](?:{MARK}?[0-9]){{13,18}}(?![0-9{MARK}])", LUHN, True, "(?<=[0-9])[ -](?=[0-9])", strict=(f"c.m rlike '^([0-9]{{4}}{MARK}?){{3,4}}[0-9]{{1,4}}$'", f"NOT c.m rlike '^([0-9]{{4}}{MARK}?){{3,4}}[0-9]{{1,4}}$'"), gazetteer=("c.m rlike '^[3-6]'", "c.m rlike '^[07-9]'"), before="card|visa|master|credit|pay"),
    Kind("phone", "[+][0-9]", r"\+[0-9][ ().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 10 AND 15", True, strict=(r"c.m rlike '^[+][0-9]{1,3} ?[(]?[0-9]'", r"NOT c.m rlike '^[+][0-9]{1,3} ?[(]?[0-9]'"), gazetteer=("c.m rlike '^[+](1|33|34|44|49|7|81|86)'", ""), before="call|phone|tel|mobile|fax", around=("", "")),
    Kind(
        "secret", "[0-9][A-Za-z_-]|[A-Za-z_-][0-9]", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+(?![A-Za-z0-9_-])", "c.m rlike '[0-9]' AND c.m rlike '[A-Za-z]'",
        strict=(f"c.m rlike '^({SECRET_PREFIXES})'", "c.m rlike '^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$' OR c.m rlike '^([A-Za-z]+[_-])+[A-Za-z]*[0-9]*([_-][0-9]+)*$' OR c.m rlike '^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$'"),
        gazetteer=(f"{RUNS} >= 6", f"{RUNS} <= 3"), before="token|secret|password|passwd|pwd|pass|api.?key|access.?key|key|auth|bearer|credentials?", around=("c.pre rlike '[=:] ?[\"\\']?$'", "c.pre rlike '[/#@.]$' OR c.post rlike '^[/@]'"),
        contrary="commit|sha-?1|sha-?256|md5|checksum|digest|hash|revision|rev|uuid|guid|build|version|order|isbn|part|serial|model|doi|blob|tree|parent|id|file|image|ticket|invoice|tracking|public.?key", check=("length(c.m) >= 20", "length(c.m) < 20"),
    ),
    Kind("ssn", "[0-9][- ][0-9]", r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])", strict=("c.m rlike '-..-'", "c.m rlike ' ..-|-.. '"), gazetteer=("left(c.m, 3) BETWEEN '001' AND '772'", "left(c.m, 3) > '899'"), before="ssn|social|security|social security number|social security no|tax id|taxpayer", contrary="part|isbn|page|order|model|serial|item|sku|ref|reference|case|phone|tel|fax|invoice|ticket|catalogue?|no|number|nr|code|version|call|id", check=("", "c.m rlike '^(000|666|9)' OR c.m rlike '[- ]00[- ]' OR c.m rlike '0000$'")),
    Kind("iban", "[A-Z]{2}[0-9]{2}", rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}[A-Z0-9{MARK}]{{10,40}}(?![A-Za-z0-9])", "c.m rlike '[0-9]{4}'", joined="(?<=[A-Z0-9]{4}) (?=[A-Z0-9]{1,4}(?![A-Za-z0-9]))", strict=(f"concat(left(c.m, 2), length({PLAIN})) IN ({', '.join(map(repr, IBAN_LENGTHS))})", f"concat(left(c.m, 2), length({PLAIN})) NOT IN ({', '.join(map(repr, IBAN_LENGTHS))})"), gazetteer=(f"left(c.m, 2) IN ({', '.join(repr(x[:2]) for x in IBAN_LENGTHS)})", f"left(c.m, 2) NOT IN ({', '.join(repr(x[:2]) for x in IBAN_LENGTHS)})"), before="iban|account|konto|cuenta|compte|acct|bank", check=(MOD97, f"NOT {MOD97}")),
    Kind(
        "name", r"\p{Ll} \p{Lu}(\p{Ll}|[.] \p{Lu})", r"(?<![\p{L}.-])\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?(?: \p{Lu}[.])?(?: \p{Lu}\p{Ll}++){1,2}(?![\p{L}-])", strict=(f"{_word_in('last', FAMILY_NAMES)} OR c.m rlike '({FAMILY_ENDINGS})$'", _word_in("last", NO_FAMILY_NAMES)),
        gazetteer=(_word_in("first", GIVEN_NAMES), _word_in("first", NO_GIVEN_NAMES)), before="mr|mrs|ms|miss|dr|prof|professor|herr|frau|señora?|sra?|mme|monsieur|madame|name is|named|sincerely|regards|by|author|contact|patient|dear|signed", around=(r"c.post rlike '^(\'s|, (age|CE|Ph|MD|bo)| (said|wrote|says))'", ""),
        contrary="the|der|die|das|la|le|les|el|los|las|in|near|at|university of|city of|company|inc|our", check=("c.m rlike ' \\\\p{Lu}[.] '", f"{_word_in('last', GIVEN_NAMES)} AND NOT {_word_in('first', GIVEN_NAMES)}"),
    ),
)
LABELERS = ("strict", "gazetteer", "before", "around", "contrary", "check")
#: What a labeler is taken to be worth before any text is seen: shares of votes against, none and for, of a false and of a true candidate.
PRIOR = {
    "strict": ((0.35, 0.5, 0.15), (0.05, 0.45, 0.5)),
    "gazetteer": ((0.35, 0.45, 0.2), (0.05, 0.4, 0.55)),
    "before": ((0.02, 0.95, 0.03), (0.02, 0.5, 0.48)),
    "around": ((0.2, 0.75, 0.05), (0.05, 0.65, 0.3)),
    "contrary": ((0.4, 0.58, 0.02), (0.02, 0.96, 0.02)),
    "check": ((0.45, 0.4, 0.15), (0.04, 0.46, 0.5)),
}
#: The same for labelers whose reliability is known and not estimated: prefixes of issued keys, and check digits.
KNOWN = {
    ("secret", "strict"): ((0.3, 0.69, 0.01), (0.02, 0.58, 0.4)),
    ("ssn", "check"): ((0.4, 0.59, 0.01), (0.01, 0.98, 0.01)),
    ("iban", "check"): ((0.95, 0.03, 0.02), (0.01, 0.01, 0.98)),
}
#: Candidates that the prior counts as, the least and as a share of all, and the share of true ones that it expects.
PRIOR_WEIGHT, PRIOR_PART, PRIOR_SHARE = 40.0, 0.5, 0.35
#: Shapes: four lengths, three shares of digits, three cases. The table of patterns has no more rows than this.
SHAPES = ((4, "CASE WHEN length(c.m) < 12 THEN '0' WHEN length(c.m) < 24 THEN '1' WHEN length(c.m) < 48 THEN '2' ELSE '3' END"), (3, f"CASE WHEN length({DIGITS}) * 4 < length(c.m) THEN '0' WHEN length({DIGITS}) * 4 < 3 * length(c.m) THEN '1' ELSE '2' END"), (3, "CASE WHEN c.m = lower(c.m) THEN '0' WHEN c.m = upper(c.m) THEN '1' ELSE '2' END"))
PATTERNS = len(KINDS) * 3 ** len(LABELERS) * 4 * 3 * 3
ORDER = {k.name: n for n, k in enumerate(KINDS)}
NEAR = 24


def _quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"' if '"' not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(lengths: str, block: int = 256) -> str:
    """SQL of the exclusive running sums of an array, by blocks, so that long arrays aren't copied for each entry."""
    sums = lambda a: f"aggregate({a}, struct(0 AS t, cast(array() AS array<int>) AS o), (s, x) -> struct(s.t + x AS t, concat(s.o, array(s.t)) AS o), s -> s.o)"
    parts = f"transform(sequence(0, (size({lengths}) - 1) DIV {block}), b -> slice({lengths}, b * {block} + 1, {block}))"
    starts = sums(f"transform({parts}, p -> aggregate(p, 0, (s, x) -> s + x))")
    return f"CASE WHEN size({lengths}) <= {block} THEN {sums(lengths)} ELSE flatten(zip_with({parts}, {starts}, (p, z) -> transform({sums('p')}, y -> y + z))) END"


def _either(conditions: tuple[str, str]) -> str:
    told = "".join(f" WHEN {c} THEN '{v}'" for c, v in zip(conditions, "20", strict=True) if c)
    return f"CASE{told} ELSE '1' END" if told else "'1'"


def _vote(kind: Kind) -> str:
    """SQL of the votes of a candidate as digits: 0 against, 1 none, 2 for."""
    near = lambda words: "c.pre rlike " + _quoted(rf"(?i)(?<![\p{{L}}])({words})[^\p{{L}}]{{0,8}}$")
    votes = (_either(kind.strict), _either(kind.gazetteer), _either((near(kind.before), "")), _either(kind.around), _either(("", near(kind.contrary))), _either(kind.check))
    return f"concat({', '.join(votes)})"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `found`: an array of (start, ord, kind, stop, base, votes, shape) of each row's candidates, sorted."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    names, shape = [], ", ".join(sql for _, sql in SHAPES)
    for kind in KINDS:
        plain = f"translate(text, '{MARK}', '\n')" if MARK in kind.pattern else "text"
        marked = f"regexp_replace({plain}, {_quoted(kind.joined)}, '{MARK}')" if kind.joined else plain
        has = f"text rlike {_quoted(kind.guard)}"
        out = out.withColumn("t", F.expr(f"CASE WHEN {has} THEN {marked} END"))
        out = out.withColumn("hits", F.expr(f"regexp_extract_all(t, {_quoted(kind.pattern)}, 0)"))
        out = out.withColumn("gaps", F.expr(f"CASE WHEN size(hits) > 0 THEN split(t, {_quoted(kind.pattern)}, -1) END"))
        # what stands before and after each match; arrays go into the functions as arguments, so that they are made once a row
        out = out.withColumns({"heads": F.expr("slice(gaps, 1, size(hits))"), "tails": F.expr("slice(gaps, 2, size(hits))")})
        out = out.withColumn("lengths", F.expr("zip_with(hits, heads, (h, g) -> length(h) + length(g))"))
        out = out.withColumn("starts", F.expr(f"CASE WHEN size(hits) > 0 THEN {_running('lengths')} END"))
        each = f"transform(arrays_zip(hits, heads, tails, starts), z -> struct(z.hits AS m, z.starts + length(z.heads) AS start, right(z.heads, {NEAR}) AS pre, left(z.tails, 8) AS post))"
        made = f"transform(filter({each}, c -> {kind.valid}), c -> struct(c.start AS start, {ORDER[kind.name]} AS ord, '{kind.name}' AS kind, c.start + length(c.m) AS stop, {str(kind.base).lower()} AS base, {_vote(kind)} AS votes, concat({shape}) AS shape))"
        name = f"of_{kind.name}"
        out = out.withColumn(name, F.expr(f"CASE WHEN size(hits) > 0 THEN {made} END"))
        names.append(name)
        out = out.drop("t", "hits", "gaps", "heads", "tails", "lengths", "starts")
    empty = "cast(array() AS array<struct<start:int,ord:int,kind:string,stop:int,base:boolean,votes:string,shape:string>>)"
    return out.select("doc_id", F.expr("array_sort(concat(" + ", ".join(f"coalesce({n}, {empty})" for n in names) + "))").alias("found"))


def pattern_counts(found: DataFrame) -> list[tuple[str, str, str, int]]:
    """(kind, votes, shape, n): how often each pattern occurs in all texts. There are no more rows than PATTERNS."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.shape").count()
    return sorted(tuple(r) for r in each.collect())


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class LabelModel:
    """What a kind's labelers are worth: reliability[labeler][truth][vote], and the share of true candidates."""

    def __init__(self, counts: dict[str, int], kind: str = "", rounds: int = 100):
        prior = [KNOWN.get((kind, x), PRIOR[x]) for x in LABELERS]
        self.reliability, self.share = [[list(side) for side in own] for own in prior], PRIOR_SHARE
        total = sum(counts.values())
        weight = PRIOR_WEIGHT + PRIOR_PART * total
        for _ in range(rounds if total else 0):
            sums = [[[weight * x for x in side] for side in own] for own in prior]
            true, moved = 0.0, 0.0
            for votes, n in counts.items():  # expectation
                p = self.probability(votes)
                true += n * p
                for own, v in zip(sums, votes, strict=True):
                    own[1][int(v)] += n * p
                    own[0][int(v)] += n * (1 - p)
            # maximisation
            made = [[[x / sum(side) for x in side] for side in own] if (kind, name) not in KNOWN else [list(side) for side in KNOWN[kind, name]] for name, own in zip(LABELERS, sums, strict=True)]
            moved = max(abs(x - y) for a, b in zip(made, self.reliability, strict=True) for s, t in zip(a, b, strict=True) for x, y in zip(s, t, strict=True))
            self.reliability, self.share = made, (true + PRIOR_WEIGHT * PRIOR_SHARE) / (total + PRIOR_WEIGHT)
            if moved < 1e-6:
                break

    def probability(self, votes: str) -> float:
        odds = math.log(self.share / (1 - self.share))
        return _logistic(odds + sum(math.log(own[1][int(v)] / own[0][int(v)]) for own, v in zip(self.reliability, votes, strict=True)))


class SpanClassifier:
    """A kind's logistic classifier over votes and shape, trained on soft labels: a bias, and a weight for each value of each feature."""

    def __init__(self, rows: list[tuple[str, float, int]], rounds: int = 400):
        self.bias, self.weights = 0.0, [[0.0] * 4 for _ in range(len(LABELERS) + len(SHAPES))]
        data = [([int(x) for x in pattern], p, math.sqrt(n)) for pattern, p, n in rows]  # rare patterns weigh by their root
        total = sum(w for *_, w in data)
        seen, seen_bias = [[1e-8] * 4 for _ in self.weights], 1e-8
        for _ in range(rounds if data else 0):
            down, below, worst = [[1e-3 * w for w in own] for own in self.weights], 0.0, 0.0
            for at, p, w in data:
                d = _logistic(self.bias + sum(own[v] for own, v in zip(self.weights, at, strict=True))) - p
                worst, step = max(worst, abs(d)), w / total * d
                below += step
                for own, v in zip(down, at, strict=True):
                    own[v] += step
            if worst < 0.02:
                break
            seen_bias += below * below
            self.bias -= 0.5 * below / math.sqrt(seen_bias)
            for own, ds, squares in zip(self.weights, down, seen, strict=True):
                for v, d in enumerate(ds):
                    squares[v] += d * d
                    own[v] -= 0.5 * d / math.sqrt(squares[v])

    def score(self, pattern: str) -> float:
        return self.bias + sum(own[int(v)] for own, v in zip(self.weights, pattern, strict=True))

    def sql(self) -> str:
        """SQL of a candidate's log odds."""
        terms = [f"element_at(array({', '.join(f'{w:.6f}D' for w in own)}), cast(substr(concat(c.votes, c.shape), {j + 1}, 1) AS int) + 1)" for j, own in enumerate(self.weights)]
        return " + ".join([f"{self.bias:.6f}D", *terms])


class SpanModel:
    """For each kind a label model, and the classifier trained on what it says of the candidates."""

    def __init__(self, counts: list[tuple[str, str, str, int]]):
        self.labels, self.classifiers = {}, {}
        for kind in KINDS:
            own = [(votes, shape, n) for k, votes, shape, n in counts if k == kind.name]
            by_votes: dict[str, int] = {}
            for votes, _, n in own:
                by_votes[votes] = by_votes.get(votes, 0) + n
            self.labels[kind.name] = label = LabelModel(by_votes, kind.name)
            self.classifiers[kind.name] = SpanClassifier([(votes + shape, label.probability(votes), n) for votes, shape, n in own])

    def accepts_sql(self) -> str:
        return "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {c.sql()} >= 0" for k, c in self.classifiers.items()) + " END"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `spans`: an array of (start, ord, kind, stop, base, votes, shape), sorted; base spans and those that the classifier takes."""
    found = candidates(docs, id_col, text_col)
    model = SpanModel(pattern_counts(found))
    return found.select("doc_id", F.expr(f"filter(found, c -> c.base OR {model.accepts_sql()})").alias("spans"))


def span_digests(spans: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256 and the spans as text."""
    listed = lambda a: f"array_join(transform({a}, c -> concat(c.kind, ':', c.start, ':', c.stop)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, c -> c.kind = '{k.name}')) AS long)").alias(f"n_{k.name}") for k in KINDS if k.base]
    return spans.select("doc_id", *counts, F.sha2(F.expr(listed("filter(spans, c -> c.base)")), 256).alias("base_sha256"), F.expr(listed("spans")).alias("spans"))
