"""Personal data by weak supervision, in DataFrame operations only.

Base spans (email, ip, card, phone) follow fixed patterns. Looser candidates
(obfuscated addresses, digit groups, long tokens) get votes from a regex, a
gazetteer and a context labeller; expectation-maximisation over the counts of
vote patterns estimates the labellers' reliabilities, and the posteriors train a
linear classifier over hashed span features, which decides what is added.

Cases: a null text is an empty one; repeated rows are judged alike; an empty
table gives an empty result; spans() replaces columns named like the added
ones, redacted() returns all columns of its input; ties can't occur.
Every column expression works on one row, so nothing of one key meets in a task;
what reaches the driver is one row for each vote pattern or hashed feature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

# The base patterns. A match begins where a run of its characters
# begins or where the last match ended (\G), as any later start in the run fails
# like the first; so long runs are read once. Possessive parts can't give back
# what the next part needs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

# Candidates of the method, its gazetteers and its context words.
AT, DOT = r" ?[\[(](?:at|AT)[\])] ?", r"(?: ?[\[(](?:dot|DOT)[\])] ?|\.)"
OBFUSCATED = rf"[A-Za-z0-9][A-Za-z0-9._%+-]*+{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z]{{2,}}+)++"
TOKEN = r"[A-Za-z0-9_+/=-]{20,}+"
DIGITS = r"[0-9][0-9 ().-]{5,}[0-9]"
CANDIDATE = rf"(?<![A-Za-z0-9._%+-])(?:{OBFUSCATED}|{TOKEN}|{DIGITS})"
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk"
CONTEXT_FOR = r"(?i)(?:token|secret|api.?key|key|passw(?:or)?d|phone|tel|telefon|mobile|call|fax|ssn|social|mail|contact|account|konto|iban|passport|card)\W{0,4}$"
CONTEXT_AGAINST = r"(?i)(?:page|figure|fig|table|chapter|section|isbn|issn|version|order|total|sum|year|no|nr|rev)\W{0,4}$"
NOT_PRIVATE = r"^(?:[12][0-9]{3}[-. ][01]?[0-9][-. ][0-3]?[0-9].*|[0-9.]+|[A-Za-z_=/+-]+)$"
STRICT_SHAPE = rf"^(?:{OBFUSCATED}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}|\(?[0-9]{{3}}\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}|(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Za-z])[A-Za-z0-9_-]{{24,}}+)$"

BUCKETS = 512
LABELLERS = ("regex", "gazetteer", "context")


def _found(text: Column, pattern: str, present: Column) -> Column:
    """Matches of ``pattern`` as (start, end, match), code points, end exclusive.

    The pieces between the matches give the places, as no pattern matches an
    empty text. Texts without ``present`` aren't searched.
    """
    p = F.lit(pattern)
    pairs = F.arrays_zip(F.split(text, pattern).alias("piece"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"))
    empty = F.expr("struct(0L as at, cast(array() as array<struct<start:bigint,end:bigint,hit:string>>) as out)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        own = F.when(x["hit"].isNotNull(), F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,hit:string>>)"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], own).alias("out"))

    return F.when(present, F.aggregate(pairs, empty, step, lambda acc: acc["out"])).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,hit:string>>)"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> Column:
    """The base spans as an array of (start, kind number, end)."""
    numbered = F.regexp_like(text, F.lit("[0-9]"))
    email = _found(text, EMAIL, text.contains("@"))
    ip = F.filter(_found(text, IP, numbered & F.regexp_like(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"))), lambda x: F.forall(F.split(x["hit"], r"\."), _small))
    card = F.filter(
        _found(text, CARD, numbered & F.regexp_like(text, F.lit("[0-9](?:[ -]?[0-9]){11}"))),
        lambda x: F.length(_digits(x["hit"])).between(12, 19) & F.call_function("luhn_check", _digits(x["hit"])),
    )
    phone = F.filter(_found(text, PHONE, text.contains("+")), lambda x: F.length(_digits(x["hit"])).between(9, 15))

    def tagged(k: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))

    return F.array_sort(F.concat(*[tagged(k, a) for k, a in enumerate((email, ip, card, phone))]))


def _bucketed(*parts: Column) -> Column:
    return F.pmod(F.hash(*parts), F.lit(BUCKETS)).cast("int")


def _candidates(text: Column, base: Column) -> Column:
    """Candidates outside the base spans, with their votes and hashed features.

    A candidate goes if a base span reaches out of it or takes half of it; a few
    digits of a long token that happen to be a card number leave it whole.
    """

    def taken(x: Column, b: Column) -> Column:
        out = (b["start"] < x["start"]) | (b["end"] > x["end"])
        return (b["start"] < x["end"]) & (x["start"] < b["end"]) & (out | (2 * (b["end"] - b["start"]) >= x["end"] - x["start"]))

    present = F.regexp_like(text, F.lit(r"[0-9]|[\[(](?:at|AT)[\])]"))
    free = F.filter(_found(text, CANDIDATE, present), lambda x: ~F.exists(base, lambda b: taken(x, b)))

    def judge(x: Column) -> Column:
        hit, digits = x["hit"], F.length(_digits(x["hit"]))
        # 24 characters before the span, of which the labeller reads the end.
        before = F.substring(text, F.greatest(x["start"] - 23, F.lit(1)).cast("int"), F.least(x["start"], F.lit(24)).cast("int"))
        kind = F.when(F.regexp_like(hit, F.lit(AT)), 0).when(F.regexp_like(hit, F.lit("[A-Za-z_+/=]")), 4).when(digits > 11, 2).otherwise(3)
        regex = F.when(F.regexp_like(hit, F.lit(STRICT_SHAPE)), 1).otherwise(-1)
        gazetteer = F.when(F.regexp_like(hit, F.lit(NOT_PRIVATE)), -1).when(F.regexp_like(hit, F.lit(rf"(?i)(?:\.|dot[\])] ?)(?:{TOP_DOMAINS})$|^(?:sk|pk|gh|AKIA)[_A-Z0-9]|^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{{32,}}$|^\(?[2-9][0-9]{{2}}\)?[ .-]555")), 1).otherwise(0)
        context = F.when(F.regexp_like(before, F.lit(rf"{CONTEXT_FOR}")), 1).when(F.regexp_like(before, F.lit(CONTEXT_AGAINST)), -1).otherwise(0)
        word = F.lower(F.regexp_extract(before, r"([A-Za-z]+)\W*$", 1))
        length, share = F.floor(2 * F.log2((x["end"] - x["start"]).cast("double"))), F.floor(4 * digits / (x["end"] - x["start"]))
        shape = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A"), 1, 12)
        features = F.array(
            _bucketed(F.lit("kind"), kind), _bucketed(F.lit("size"), kind, length), _bucketed(F.lit("share"), kind, share), _bucketed(F.lit("shape"), shape), _bucketed(F.lit("word"), word),
            _bucketed(F.lit("votes"), kind, regex, gazetteer, context),
        )
        return F.struct(x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end"), F.array(regex, gazetteer, context).alias("votes"), features.alias("features"))

    return F.transform(free, judge)


def em(patterns: dict[tuple[int, ...], int], rounds: int = 40) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """Posterior of "private" for each pattern of votes, and the reliabilities."""
    k = len(next(iter(patterns), ()))
    total = sum(patterns.values()) or 1
    rates = [{True: {1: 0.7, -1: 0.1}, False: {1: 0.1, -1: 0.7}} for _ in range(k)]
    prior, posterior = 0.5, {}

    def rate(i: int, c: bool, v: int) -> float:
        return rates[i][c][v] if v else max(1e-6, 1 - rates[i][c][1] - rates[i][c][-1])

    for _ in range(rounds):
        for p in patterns:
            a = prior * math.prod(rate(i, True, v) for i, v in enumerate(p))
            b = (1 - prior) * math.prod(rate(i, False, v) for i, v in enumerate(p))
            posterior[p] = a / (a + b)
        prior = min(0.95, max(0.05, sum(n * posterior[p] for p, n in patterns.items()) / total))
        for i in range(k):
            for c in (True, False):
                mass = {p: n * (posterior[p] if c else 1 - posterior[p]) for p, n in patterns.items()}
                for v in (1, -1):  # the starting rates count as 20 spans, so a labeller doesn't turn round
                    start = (0.7 if (v == 1) == c else 0.1) * 20
                    rates[i][c][v] = (sum(m for p, m in mass.items() if p[i] == v) + start) / (sum(mass.values()) + 20)
    return posterior, rates


def fit(docs: DataFrame) -> dict:
    """Reliabilities and the span classifier from every candidate of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.select(text.alias("text")).select(F.explode(_candidates(F.col("text"), base_spans(F.col("text")))).alias("x")).select("x.votes", "x.features")
    # Votes and features are counted together: at most 27 x 512 rows.
    sums = spans.select("votes", F.explode("features").alias("f")).groupBy("votes", "f").agg(F.count("*").alias("n")).collect()
    patterns: dict[tuple[int, ...], int] = {}
    for r in sums:
        patterns[tuple(r["votes"])] = patterns.get(tuple(r["votes"]), 0) + r["n"]
    posterior, rates = em({p: n // 6 for p, n in patterns.items()})
    yes, no = [0.0] * BUCKETS, [0.0] * BUCKETS
    for r in sorted(sums, key=lambda r: (r["f"], tuple(r["votes"]))):
        p = posterior[tuple(r["votes"])]
        yes[r["f"]] += r["n"] * p
        no[r["f"]] += r["n"] * (1 - p)
    a, b = sum(yes) / 6 + 1, sum(no) / 6 + 1
    weights = [round(math.log((y + 0.5) / a) - math.log((n + 0.5) / b), 9) if y + n else 0.0 for y, n in zip(yes, no)]
    return {"weights": weights, "bias": round(math.log(a / b), 9), "rates": dict(zip(LABELLERS, rates))}


def spans(docs: DataFrame, model: dict | None = None, names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind number, end).

    ``names``: of the two columns; input columns of these names are replaced.

    Kinds 0 to 3 are email, ip, card and phone, 4 is a secret. ``spans`` holds
    the base spans and those that the classifier adds.
    """
    model = model or fit(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    weights = F.array(*[F.lit(w) for w in model["weights"]])
    added = F.transform(
        F.filter(_candidates(text, F.col(names[0])), lambda x: F.aggregate(x["features"], F.lit(model["bias"]), lambda s, f: s + F.get(weights, f)) > 0),
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")),
    )
    return docs.drop(*names).withColumn(names[0], base_spans(text)).withColumn(names[1], F.array_sort(F.concat(names[0], added)))


def listed(column: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "secret")])
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind, as in <EMAIL>.

    Spans that overlap become one mark, of the first one's kind. Null texts stay
    null; ``n_chars``, where it is a column, is counted anew for changed texts.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in (*KINDS, "secret")])
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        between = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], between, F.get(names, x["kind"]))).otherwise(acc["out"]).alias("out"))

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    names_of = (free(docs.columns, "base"), free(docs.columns, "spans"))
    whole = F.aggregate(names_of[1], empty, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    out = spans(docs, model, names_of).withColumn("text", F.when(F.size(names_of[1]) > 0, whole).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(names_of[1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def counted(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

