"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, edit_sketch, mixing, near_dedup, periodic, pii, quality, resample, suffix_dedup, url_filter, warc
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.counted(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return docs.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontaminate.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "tokens")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score and whether the classifier keeps it."""
    docs = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), columns=["doc_id"])
    return docs.select("doc_id", F.round("quality_score", 6).alias("quality_score"), "keep")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sampled(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return docs.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("probability", 4).alias("probability"), "copies")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.sql("select -1L as conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role)").select("conv_id", "turn", "role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = chat.read_back(chat.reply_trees(chat.as_messages(given.unionByName(probe))))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.when(F.col("tree") != "", F.col("tree").try_cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.find(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=periodic.repeating)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    # Of two runs the first is greater if its length times the other's period is.
    greater = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    docs = docs.withColumn("top", F.aggregate("runs", none, greater))
    return docs.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("top")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("fingerprint", edit_sketch.fingerprint("text"))
    ranges = min(16_384, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = edit_sketch.in_order(docs, "doc_id", ranges)
    pairs = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint", F.col("next.fingerprint").alias("following"), edit_sketch.spliced(F.col("text"), F.col("next.text")).alias("edited"))
    pairs = pairs.withColumn("edited_fingerprint", edit_sketch.fingerprint("edited"))
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", edit_sketch.likeness("fingerprint", "edited_fingerprint").alias("near_edited"), edit_sketch.likeness("fingerprint", "following").alias("near_next"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resampled(docs, table(spark, sf_dir, "benchmark"), parts=min(16_384, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pii, op2_decontaminate, op3_url_filter, op4_quality, op5_suffix_dedup, op6_mixing, op7_ann, op8_warc, op9_near_dedup, op10_chat, op11_periodic_runs, op12_edit_fingerprints, op13_resample)
    return {f.__name__: f for f in ops}


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH items AS (SELECT item_id, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS g, 13 AS n FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM items WHERE len(w) >= 13)
  UNION SELECT DISTINCT item_id, array_to_string(w, ' '), len(w) FROM items WHERE len(w) BETWEEN 1 AND 12),
docs AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
found AS MATERIALIZED (SELECT r, i, grams.n, item_id FROM grams JOIN windows ON grams.g = windows.g AND grams.n = windows.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
q AS (SELECT page_id, octet_length(encode(x))::BIGINT AS payload_bytes, sha256(x) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
"""


#: The checksums of single bytes, and of words from those: each byte is looked up with the lowest byte so far.
OP13_SQL = f"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM documents),
dw AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all({FOLDED}, '{WORD}')) AS w FROM benchmark) GROUP BY ALL),
vocabulary AS (SELECT w FROM dw UNION SELECT w FROM bw),
hashed AS MATERIALIZED (SELECT w, xor(list_reduce(list_transform(range(0, octet_length(encode(w)) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT END), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN hashed USING (w) GROUP BY 1),
b AS (SELECT bucket, coalesce(s, 0)::BIGINT AS s, coalesce(t, 0)::BIGINT AS t FROM range(10000) x(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM b),
weighed AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT AS h FROM d LEFT JOIN weighed USING (r)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM h),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op6_mixing": mixing.sql(), "op8_warc": OP8_SQL, "op13_resample": OP13_SQL}
