"""Mixing sources to target weights by iterative proportional fitting.

The tokens of every source, language and topic are counted in cells; the cells'
weights are raked to the three target marginals in turn. A document's expected
copies are its cell's weight over the cell's tokens, and a number that its id
fixes decides about the fraction.

Cases: null sources and languages are one group of their own (''); null and
empty texts have no tokens and get no copies, and where no document has tokens
nothing is drawn; repeated rows are drawn alike; an
empty table gives an empty result. Only cells, never documents, meet in the
raking, so a source with a third of the rows is one row there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a value: its share of all tokens to this power, scaled to 1.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS, BUDGET, SEED = 10, 0.6, "mix-1"

# What tells the topics, in the order in which they count. A text has
# a topic if it holds one of the strings and, where there is one, fits the pattern;
# the strings are found faster than patterns, and most texts hold none.
TOPICS = (
    ("contact", ("@",), "@[A-Za-z0-9-]+[.]"),
    ("code", ("=",), "[A-Za-z0-9_] ?= ?[\"{0-9]"),
    ("legal", ("icense", "icence", "opyright", "arranty"), None),
    ("list", (" | ",), None),
)


def topic(text: Column) -> Column:
    out = None
    for name, strings, pattern in TOPICS:
        fits = reduce(Column.__or__, [F.contains(text, F.lit(s)) for s in strings])
        fits = fits & F.regexp_like(text, F.lit(pattern)) if pattern else fits
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("prose")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with __source, __lang, __topic and __tokens."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"__source": F.coalesce("source", F.lit("")), "__lang": F.coalesce("lang", F.lit("")), "__topic": topic(text), "__tokens": F.regexp_count(text, F.lit("[^ \t\n\r]+")).cast("long")})


def raked(cells: DataFrame, *, exponents: dict = EXPONENTS, rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``weight``, of which the sum is that of their tokens, and their goals.

    A round scales the cells of each source, which are few, then those of each
    language and topic. For the latter the sums by language and topic are enough:
    they are summed before the shuffle, raked as a small table and joined back.
    Each round's weights are written to the shared folder. Cells without tokens
    have the weight 0.
    """
    one = float(cells.agg(F.sum("tokens")).first()[0] or 0)

    def goals(table: DataFrame, d: str) -> DataFrame:
        sums = table.groupBy(d).agg(F.pow(F.sum("tokens") / F.lit(max(one, 1.0)), F.lit(float(exponents[d]))).alias("p"))
        norm = sums.agg(F.sum("p")).first()[0] or 1.0
        return sums.select(d, (F.col("p") / F.lit(norm) * F.lit(one)).alias(f"goal_{d}"))

    def scaled(d: str, weight: str) -> Column:
        now = F.sum(weight).over(Window.partitionBy(d))
        return F.when(now > 0, F.col(weight) * F.col(f"goal_{d}") / now).otherwise(0.0)

    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        out = out.join(goals(cells, d), d)
    for _ in range(rounds):
        out = stored(out.withColumn("weight", scaled("source", "weight")), "raked")
        sums = out.groupBy("lang", "topic").agg(F.sum("weight").alias("was"), F.first("goal_lang").alias("goal_lang"), F.first("goal_topic").alias("goal_topic")).withColumn("now", F.col("was"))
        for d in ("lang", "topic"):
            sums = sums.withColumn("now", scaled(d, "now"))
        factors = sums.select("lang", "topic", F.coalesce(F.try_divide("now", "was"), F.lit(0.0)).alias("factor"))
        out = out.join(factors, ["lang", "topic"]).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
    return out


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that key and seed fix, the same in any SQL engine."""
    digest = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def sampled(docs: DataFrame, *, budget: float = BUDGET, seed: str = SEED, **options) -> DataFrame:
    """The documents drawn, with __source ... __tokens, probability and copies.

    ``budget``: the expected tokens, copies counted, as a share of all tokens.
    """
    known = measured(docs.drop("probability", "copies"))
    cells = stored(known.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("__tokens").alias("tokens")), "cells")
    rates = stored(raked(cells, **options).where("tokens > 0").select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), (F.col("weight") * F.lit(budget) / F.col("tokens")).alias("__rate")), "rates")
    out = known.join(rates, ["__source", "__lang", "__topic"]).where(F.col("__tokens") > 0)
    whole = F.floor("__rate")
    copies = whole + (uniform(F.col("doc_id"), seed) < F.col("__rate") - whole).cast("long")
    return out.withColumn("probability", F.least(F.col("__rate"), F.lit(1.0))).withColumn("copies", copies).where("copies > 0")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, probability and copies of the documents drawn.

    Input columns named probability and copies are replaced; other names, whatever
    they are, come back as they were.
    """
    known = ("doc_id", "text", "source", "lang")
    drawn = sampled(docs.select(*known, F.struct("*").alias("row")), **options)
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("probability", "copies")], "probability", "copies")


def sql(budget: float = BUDGET, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same as one DuckDB statement over the view documents."""
    fits = lambda strings, pattern: "(" + " OR ".join(f"contains(x, '{s}')" for s in strings) + ")" + (f" AND regexp_matches(x, '{pattern}')" if pattern else "")
    cue = " ".join(f"WHEN {fits(s, p)} THEN '{t}'" for t, s, p in TOPICS)
    steps = [
        "m AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE " + cue + " ELSE 'prose' END AS topic, len(regexp_extract_all(x, '[^ \\t\\n\\r]+'))::BIGINT AS tokens FROM (SELECT *, coalesce(text, '') AS x FROM documents))",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS weight FROM m GROUP BY ALL)",
        "one AS MATERIALIZED (SELECT sum(tokens) AS t FROM w0)",
    ]
    for d in DIMENSIONS:
        steps.append(f"g_{d} AS MATERIALIZED (SELECT {d}, p / sum(p) OVER () * t AS goal FROM (SELECT {d}, pow(sum(tokens) / any_value(t), {float(EXPONENTS[d])}) AS p, any_value(t) AS t FROM w0, one GROUP BY {d}))")
    last = "w0"
    for i in range(rounds):
        for d in DIMENSIONS:
            steps.append(f"w{i}_{d} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN s > 0 THEN weight * goal / s ELSE 0.0 END AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY {d}) AS s FROM {last}) JOIN g_{d} USING ({d}))")
            last = f"w{i}_{d}"
    steps.append(f"r AS (SELECT m.*, weight * {budget} / c.tokens AS rate, ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), '{seed}')), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)} AS u FROM m JOIN {last} c USING (source, lang, topic) WHERE m.tokens > 0)")
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, tokens AS n_tokens, round(least(rate, 1.0), 4) AS probability, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies FROM r WHERE floor(rate) + (u < rate - floor(rate))::INT > 0"
