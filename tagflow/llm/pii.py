"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from one pattern for each shape. Four labelers vote on each (yes, no, abstain): the
pattern with its checks (Luhn, octets, number of digits), a gazetteer (mail domains, issuer and
country prefixes, private networks, key prefixes), the words to its left, and its borders. Expectation
maximisation over the votes estimates each labeler's reliability and each candidate's probability;
those train the final span classifier, a logistic model over the votes, the kind, the length and the
share of digits. Spans that a base pattern accepts stay whatever the classifier says; it adds others.

The corpus is read twice at most (statistics, then spans); the statistics are counts by vote and
feature pattern, whose number the code bounds (``PATTERNS``), so the two small fits run on those
counts on the driver. All work on texts stays in the row: no shuffle, no Python on the executors.

Patterns are written without backtracking over repeated groups, so a long run of digits or letters
takes time in proportion. They find what the plain forms below find, leftmost and without overlap:
a match can begin only where a run of its first characters begins or where the match before ended.

Defined cases: a null or empty text has no spans; repeated rows get a row each; without candidates
the classifier accepts none; an empty table gives no rows; positions are code points, end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import state_path
from .arrays import bound, replaced, scan
from .common import column, documents, unused

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Plain forms: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+){3}, card
#: [0-9]([ -]?[0-9])+ with 12 digits or more, phone \+[0-9][ ().0-9-]+[0-9].
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Shapes beyond the base: a written-out address, a number without its country, a key.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,}+"
LOCAL = r"(?<![0-9+(.-])(?<![0-9+] )(?<![0-9+] \()\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+"

# Gazetteers of prefixes and domains, words of a context.
MAIL_DOMAINS = r"(?i)(?:@|\(at\) ?|\[at\] ?)(?:[a-z0-9-]+\.)*(?:example\.(?:com|org|net)|gmail\.com|yahoo\.com|hotmail\.com|outlook\.com|gmx\.de|web\.de|orange\.fr|free\.fr)$"
COMMON_ENDS = r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|us)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|62|64|65)"
COUNTRIES = r"^\+(?:1|7|20|27|3[0-69]|4[0-1]|4[3-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
PRIVATE = r"^(?:10\.|127\.|0\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|255\.)"
KEY_PREFIXES = r"^(?:sk-|sk_|pk_|ghp_|xox[bp]-|AKIA|AIza)"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\W*$",
    "ip": r"(?i)(?:\bip|address|host|server|from|login)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|payment|tarjeta|carte|karte)\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefono|telefon)\W*$",
    "secret": r"(?i)(?:token|secret|password|passwd|api[_-]?key|key|bearer)\W*$",
}
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|section|chapter|total|page|figure|build|commit|sha1?|checksum)\W*$"

LEFT = 32
VOTES = 4
LENGTHS = (8, 14, 20, 32)
#: Feature patterns there can be: kinds, votes of each labeler, lengths, shares of digits, base or not.
PATTERNS = len(KINDS) * 3 ** VOTES * (len(LENGTHS) + 1) * 3 * 2

_CANDIDATE = ("array<struct<start:long,kind:int,end:long,base:boolean,v1:int,v2:int,v3:int,v4:int,"
              "len:int,digits:int>>")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card_ok(m: Column) -> Column:
    digits = _digits(m)
    return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


@dataclass(frozen=True)
class Shape:
    kind: str
    pattern: str
    gate: Column  # what a text must hold for the pattern to match at all
    base: bool  # whether a match that passes the checks is a base span
    passes: object  # match -> Column
    gazetteer: object


def shapes(text: Column) -> list[Shape]:
    false = F.lit(False)
    return [
        Shape("email", EMAIL, F.contains(text, F.lit("@")), True, lambda m: F.lit(True),
              lambda m: _vote(m.rlike(MAIL_DOMAINS) | m.rlike(COMMON_ENDS), false)),
        Shape("ip", IP, text.rlike(r"[0-9]\.[0-9]"), True, lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
              lambda m: _vote(false, m.rlike(PRIVATE))),
        Shape("card", CARD, text.rlike(r"[0-9][0-9 -]{10,}+"), True, _card_ok,
              lambda m: _vote(_digits(m).rlike(ISSUERS), ~_digits(m).rlike(ISSUERS))),
        Shape("phone", PHONE, F.contains(text, F.lit("+")), True, lambda m: F.length(_digits(m)).between(9, 15),
              lambda m: _vote(m.rlike(COUNTRIES), ~m.rlike(COUNTRIES))),
        Shape("email", SPELLED, text.rlike(r"\(at\)|\[at\]"), False, lambda m: F.lit(True),
              lambda m: _vote(m.rlike(MAIL_DOMAINS) | m.rlike(COMMON_ENDS), false)),
        Shape("phone", LOCAL, text.rlike(r"[0-9]{3}[ .-][0-9]{4}"), False, lambda m: F.lit(True),
              lambda m: _vote(_digits(m).rlike("^[2-9][0-9]{2}[2-9]"), ~_digits(m).rlike("^[2-9]"))),
        Shape("secret", SECRET, text.rlike(r"[A-Za-z0-9_-]{24}"), False,
              lambda m: m.rlike("[0-9].*[0-9].*[0-9]") & m.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]"),
              lambda m: _vote(m.rlike(KEY_PREFIXES) | m.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), ~m.rlike("[0-9]"))),
    ]


def _found(text: Column, shape: Shape) -> Column:
    """Candidates of one shape, in order: positions are sums over what lies between matches and the matches."""
    matches = F.regexp_extract_all(text, F.lit(shape.pattern), F.lit(0))
    between = F.split(text, shape.pattern, -1)
    both = F.zip_with(matches, between, lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    ahead = F.zip_with(both, F.slice(between, 2, 2_147_483_647), lambda x, b: F.struct(
        x["m"].alias("m"), F.length(x["b"]).alias("gap"), F.right(x["b"], F.lit(LEFT)).alias("left"),
        F.substring(b, 1, 1).alias("after")))
    kind = KINDS.index(shape.kind)

    def one(x: Column, start: Column) -> Column:
        m = x["m"]
        passed = shape.passes(m)
        border = ~x["left"].rlike(r"[\p{L}\p{N}_]$") & ~x["after"].rlike(r"[\p{L}\p{N}_]")
        return F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"),
            (passed if shape.base else F.lit(False)).alias("base"), _vote(passed, ~passed).alias("v1"),
            shape.gazetteer(m).alias("v2"), _vote(x["left"].rlike(CONTEXT[shape.kind]), x["left"].rlike(AGAINST)).alias("v3"),
            _vote(border, ~border).alias("v4"),
            sum((F.length(m) > n).cast("int") for n in LENGTHS).alias("len"),
            F.floor(F.length(_digits(m)) * 2.999 / F.length(m)).cast("int").alias("digits"))

    def all_of(some: Column) -> Column:
        starts = scan(some, F.lit(0).cast("long"), "bigint",
                      lambda at, x: (at + x["gap"] + F.length(x["m"]), at + x["gap"]))
        return F.zip_with(some, starts, one).cast(_CANDIDATE)

    some = F.filter(ahead, lambda x: x["m"].isNotNull())  # what follows the last match stands last
    return F.when(shape.gate, bound(some, all_of)).otherwise(F.array().cast(_CANDIDATE))


def candidates(docs: DataFrame, out_col: str = "candidates", text_col: str = "text") -> DataFrame:
    """docs with the candidates of each text, in the order of start and kind.

    A candidate beyond the base gives way to a base match that it overlaps: one pass over all in their order knows
    how far base matches have reached, one back where the next begins.
    """
    text = F.coalesce(column(text_col), F.lit(""))

    def marked(shape: Shape) -> Column:
        extra = int(not any(shape is s for s in of_base))
        return F.transform(_found(text, shape), lambda c: F.struct(c["start"].alias("start"), F.lit(extra).alias("extra"), c.alias("c")))

    every = shapes(text)
    of_base = every[:sum(s.base for s in every)]

    def free(both: Column) -> Column:
        is_base = lambda x: x["extra"] == 0
        before = scan(both, F.lit(0).cast("long"), "boolean", lambda reach, x: (
            F.when(is_base(x), F.greatest(reach, x["c"]["end"])).otherwise(reach), ~is_base(x) & (x["start"] < reach)))
        after = bound(F.reverse(both), lambda back: F.reverse(scan(back, F.lit(2 ** 62), "boolean", lambda next_one, x: (
            F.when(is_base(x), x["start"]).otherwise(next_one), ~is_base(x) & (x["c"]["end"] > next_one)))))
        gone = F.zip_with(before, after, lambda a, b: a | b)
        kept = F.filter(F.zip_with(both, gone, lambda x, g: F.struct(x["c"].alias("c"), g.alias("g"))), lambda x: ~x["g"])
        return F.transform(kept, lambda x: x["c"])

    return docs.withColumn(out_col, bound(F.array_sort(F.concat(*[marked(s) for s in every])), free))


def _features(kind: int, votes: tuple[int, ...], length: int, digits: int) -> list[str]:
    return ["bias", f"kind{kind}", *(f"v{n + 1}={v}" for n, v in enumerate(votes) if v), f"len{length}", f"digits{digits}"]


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 100) -> tuple[dict, dict]:
    """Expectation maximisation over (kind, votes, count): the probability of each (kind, votes), and of each vote."""
    belief = {(k, v): min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for k, v, _ in counts}
    votes: dict = {}
    for _ in range(rounds):
        prior, total = {}, {}
        votes = {(n, c, v): 1.0 for n in range(VOTES) for c in (0, 1) for v in (-1, 0, 1)}  # add-one smoothing
        for k, v, n in counts:
            p = belief[k, v]
            prior[k] = prior.get(k, 1.0) + n * p
            total[k] = total.get(k, 2.0) + n
            for at, x in enumerate(v):
                votes[at, 1, x] += n * p
                votes[at, 0, x] += n * (1 - p)
        sums = {(at, c): sum(votes[at, c, x] for x in (-1, 0, 1)) for at in range(VOTES) for c in (0, 1)}
        votes = {(at, c, x): w / sums[at, c] for (at, c, x), w in votes.items()}
        new = {}
        for k, v in belief:
            odds = math.log(prior[k] / max(total[k] - prior[k], 1e-9))
            odds += sum(math.log(votes[at, 1, x] / votes[at, 0, x]) for at, x in enumerate(v))
            new[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        moved = max((abs(new[x] - belief[x]) for x in belief), default=0)
        belief = new
        if moved < 1e-6:
            break
    return belief, votes


def train(patterns: list[tuple[int, tuple[int, ...], int, int, int]], rounds: int = 400, rate: float = 0.5,
          decay: float = 1e-3) -> dict[str, float]:
    """Weights of the span classifier. patterns: (kind, votes, length, digits, count); targets are EM's beliefs."""
    belief, _ = reliabilities([(k, v, n) for k, v, _, _, n in patterns])
    # square roots of counts: a frequent pattern teaches more, but doesn't drown the others
    rows = [(_features(k, v, a, b), belief[k, v], math.sqrt(n)) for k, v, a, b, n in patterns]
    whole = sum(n for *_, n in rows) or 1.0
    weights = dict.fromkeys((f for fs, _, _ in rows for f in fs), 0.0)
    for _ in range(rounds if rows else 0):
        gradient = {f: decay * w for f, w in weights.items()}
        for fs, target, n in rows:
            wrong = (1 / (1 + math.exp(-sum(weights[f] for f in fs))) - target) * n / whole
            for f in fs:
                gradient[f] += wrong
        for f, g in gradient.items():
            weights[f] -= rate * g * 4
    return weights


def fit(found: DataFrame, col: str = "candidates") -> dict[str, float]:
    """found: rows with candidates. Counts by pattern (at most PATTERNS) go to the driver."""
    fields = ["kind", "v1", "v2", "v3", "v4", "len", "digits"]
    counts = (found.select(F.explode(column(col)).alias("c")).groupBy(*[F.col(f"c.{f}").alias(f) for f in fields])
              .agg(F.count(F.lit(1)).alias("n")).collect())
    return train(sorted((r["kind"], (r["v1"], r["v2"], r["v3"], r["v4"]), r["len"], r["digits"], r["n"]) for r in counts))


def classified(found: DataFrame, weights: dict[str, float], col: str = "candidates", out_col: str = "spans") -> DataFrame:
    """found with out_col: base spans and those the classifier accepts, as (start, kind, end, base)."""
    def score(x: Column) -> Column:
        total = F.lit(weights.get("bias", -1.0))
        for field, name in (("kind", "kind"), ("len", "len"), ("digits", "digits")):
            for feature, w in sorted(weights.items()):
                if feature.startswith(name) and feature[len(name):].isdigit():
                    total = total + F.when(x[field] == int(feature[len(name):]), w).otherwise(0.0)
        for n in range(1, VOTES + 1):
            for v in (-1, 1):
                if w := weights.get(f"v{n}={v}"):
                    total = total + F.when(x[f"v{n}"] == v, w).otherwise(0.0)
        return total

    kept = F.filter(column(col), lambda x: x["base"] | (score(x) > 0))
    return found.withColumn(out_col, F.transform(kept, lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"))))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by its first kind, as [KIND]."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return replaced(text, spans, lambda x: F.get(marks, x["kind"]))


def find_pii(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a column of spans, and that column's name; the classifier is fitted on docs."""
    name = unused(docs, "pii_candidates")
    found = candidates(docs, name, text_col)
    weights = fit(found.select(column(name)), name)
    out = unused(docs, "pii_spans")
    return classified(found, weights, name, out).drop(name), out


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = state_path(spark, "pii-candidates")
    candidates(documents(spark, sf_dir)).select("doc_id", "candidates").write.parquet(path)
    found = spark.read.parquet(path)
    done = classified(found, fit(found))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == BASE.index(kind))).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", *[count(k) for k in BASE], F.sha2(as_text(base), 256).alias("base_sha256"),
                       as_text(F.col("spans")).alias("spans"))


QUERIES = {"op1_pii_weak_supervision": op1_pii_weak_supervision}
ORACLE_SQL: dict[str, str] = {}
