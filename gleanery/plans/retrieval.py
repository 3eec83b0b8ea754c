"""The gated search projection and retrieval over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import exprs, tables
from gleanery.operators import filters, fulltext, retrieval

from . import searching
from .registry import query

#: The fields that a search reads, with the labels of their weights.
FIELDS = {"source": "A", "lang": "B", "text": "C"}
ASKED, LANGUAGES = "thing onanea", ["en", "fr"]
FOUND = searching.search(ASKED, FIELDS, where="lang IN ('en', 'fr')")
WORDS = f"{FOUND}, w AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (SELECT * FROM found ORDER BY score DESC, doc_id LIMIT 400))"
COSINE = "list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x))))"
#: The embeddings, those of current content, and the nearest; MADE_OF is filled in by the queries.
NEAREST = f"""e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings),
MADE_OF,
v AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS place FROM (SELECT vec_id, round({COSINE}, 9) AS score FROM fresh WHERE sqrt(list_sum(list_transform(v, lambda x: x * x))) > 0 ORDER BY score DESC, vec_id LIMIT 400))"""
VECTORS = NEAREST.replace("MADE_OF", "fresh AS (SELECT e.* FROM e JOIN (SELECT doc_id, sha256(text) AS h, CASE WHEN lang = 'de' AND n_chars > 2000 THEN sha256(concat(sha256(text), ' edited')) ELSE sha256(text) END AS made_of FROM documents WHERE lang IN ('en', 'fr', 'de')) d ON doc_id = vec_id AND h = made_of)")
EVERY_VECTOR = NEAREST.replace("MADE_OF", "fresh AS (SELECT e.* FROM e JOIN (SELECT doc_id, sha256(text) AS h FROM documents) d ON doc_id = vec_id JOIN (SELECT doc_id AS id, sha256(CASE WHEN lang = 'de' AND n_chars > 2000 THEN concat(text, ' ') ELSE text END) AS made_of FROM documents) m ON id = vec_id AND made_of = h)")


def search_index(t) -> fulltext.Index:
    """The index of all documents, with what filters and vectors need of them."""
    keep = {"language": F.col("lang"), "content_hash": F.sha2("text", 256), "size": F.col("n_chars")}
    return fulltext.index(t("documents"), "doc_id", FIELDS, keep)


def words(t) -> DataFrame:
    found = fulltext.matches(search_index(t), ASKED, language=LANGUAGES)
    return retrieval.ranked(found, "score", "doc_id", retrieval.candidates(20))


def nearest(t, made_of: DataFrame, current: DataFrame) -> DataFrame:
    """The embeddings nearest to the first, of those made from current content."""
    usable = retrieval.fresh(t("embeddings").join(made_of, "vec_id"), current, "vec_id")
    first = t("embeddings").where("vec_id = 0").select("embedding").first()  # the query's vector, one row
    return retrieval.vector(usable, first and first["embedding"], "vec_id", retrieval.candidates(20))


def vectors(t) -> DataFrame:
    """The nearest embeddings of current content in three languages; long German documents were edited since.

    The hash of each text was taken when the index was built; no text is read.
    """
    known = filters.where(search_index(t).documents, language=["en", "fr", "de"]).withColumnRenamed("key", "vec_id")
    edited = (F.col("language") == "de") & (F.col("size") > 2000)
    made_of = known.select("vec_id", F.when(edited, F.sha2(F.concat("content_hash", F.lit(" edited")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return nearest(t, made_of, known)


@query(f"WITH {WORDS} SELECT doc_id, score, place, round(1.0 / (60 + place), 9)::DOUBLE AS fused_score FROM w WHERE place <= 20")
def keyword_search(t) -> DataFrame:
    """Documents in two languages that hold both words, by cover density."""
    return words(t).where("place <= 20").select("doc_id", "score", "place", F.round(1.0 / (60 + F.col("place")), 9).alias("fused_score"))


@query(f"WITH {EVERY_VECTOR} SELECT vec_id, score, place FROM v WHERE place <= 20")
def vector_topk(t) -> DataFrame:
    """The nearest embeddings of current content in all languages; long German documents were edited since.

    It hashes the texts itself: an index of their words would cost more than it gives here.
    """
    d = t("documents").select(F.col("doc_id").alias("vec_id"), "text", "lang", "n_chars")
    edited = (F.col("lang") == "de") & (F.col("n_chars") > 2000)
    current = d.select("vec_id", F.sha2("text", 256).alias("content_hash"))
    made_of = d.select("vec_id", F.sha2(F.when(edited, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("content_hash"))
    return nearest(t, made_of, current).where("place <= 20")


@query("SELECT label::BIGINT AS label, count(*) AS embeddings, count(*) FILTER (WHERE md5(concat('doc', vec_id)) = md5(concat('doc', CASE WHEN vec_id % 9 = 0 THEN vec_id + 1 ELSE vec_id END))) AS fresh FROM embeddings GROUP BY 1")
def stale_embedding_guard(t) -> DataFrame:
    key = lambda x: F.md5(F.concat(F.lit("doc"), x.cast("string")))
    i = F.col("vec_id")
    embedded = t("embeddings").select("vec_id", F.col("label").cast("long").alias("label"), key(F.when(i % 9 == 0, i + 1).otherwise(i)).alias("content_hash"))
    current = t("embeddings").select("vec_id", key(i).alias("content_hash"), F.lit(1).alias("fresh"))
    return embedded.join(current, ["vec_id", "content_hash"], "left").groupBy("label").agg(F.count("*").alias("embeddings"), F.count("fresh").alias("fresh"))


FUSION = f"""
WITH {WORDS}, {VECTORS}
SELECT coalesce(doc_id, vec_id) AS doc_id, w.place AS word_place, v.place AS vector_place, round(coalesce(1.0::DOUBLE / (60 + w.place), 0) + coalesce(0.55::DOUBLE / (60 + v.place), 0), 9) AS score
FROM w FULL JOIN v ON doc_id = vec_id ORDER BY score DESC, 1 LIMIT 20"""


@query(FUSION.replace("AS score", "AS score, 'hybrid' AS mode"))
def rrf_fusion(t) -> DataFrame:
    return retrieval.hybrid(words(t), vectors(t).withColumnRenamed("vec_id", "doc_id"), "doc_id", filters.clamp(20, 20, 1, 50), base=t("embeddings"))


@query(FUSION)
def candidate_function(t) -> DataFrame:
    """The same fusion by a table function in SQL."""
    spark = t("embeddings").sparkSession
    tables.register(spark)
    lists = words(t).select(F.col("doc_id").alias("key"), F.lit("words").alias("branch"), "place").unionByName(vectors(t).select(F.col("vec_id").alias("key"), F.lit("vectors").alias("branch"), "place"))
    lists.withColumn("request", F.lit(1)).createOrReplaceTempView("__lists")
    return spark.sql("SELECT key AS doc_id, word_place, vector_place, score FROM candidates(TABLE(__lists) PARTITION BY (request), 20)")


PROJECTION = """
WITH s AS (SELECT d.doc_id, lang, source, coalesce(l.quality = 1, false) AS has_quality, coalesce(l.toxic = 1, false) AS flagged, text AS title, coalesce(g.enabled, false) AS gate
  FROM documents d LEFT JOIN labels l USING (doc_id) JOIN (VALUES ('en', true), ('de', false), ('fr', true)) g(lang, enabled) USING (lang)),
o AS (SELECT o_orderkey AS doc_id, string_agg(DISTINCT l_returnflag, ' ' ORDER BY l_returnflag) AS flags FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT s.doc_id, lang, source, gate AND has_quality AS ready, flagged, coalesce(flags, '') AS flags, concat_ws(' ', title, source, coalesce(flags, '')) AS search_text, title, has_quality FROM s LEFT JOIN o USING (doc_id)),
q AS (SELECT *, sha256(concat_ws('|', '=' || doc_id, '=' || title, '=' || source)) AS semantic_hash FROM p)
SELECT doc_id, lang, ready, flagged, flags, search_text, semantic_hash, sha256(concat_ws('|', '=' || semantic_hash, '=' || ready, '=' || flagged, '=' || flags)) AS content_hash FROM q"""


@query(PROJECTION)
def search_projection(t) -> DataFrame:
    """One document for each row in an open language: gates, flags, arrays, text, two hashes.

    The semantic hash leaves out gates and flags, so embeddings outlive them.
    """
    gates = t("documents").sparkSession.createDataFrame([("en", True), ("de", False), ("fr", True)], "lang string, enabled boolean")
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    marks = t("labels").select("doc_id", is_one("quality").alias("q"), is_one("toxic").alias("x"))
    flags = t("lineitem").join(t("documents").select(F.col("doc_id").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), " ").alias("flags"))
    docs = t("documents").select("doc_id", "lang", "source", F.col("text").alias("title"))
    staged = docs.join(F.broadcast(gates), "lang").join(marks, "doc_id", "left").join(flags, "doc_id", "left").withColumns({"flags": F.coalesce("flags", F.lit("")), "ready": F.col("enabled") & F.coalesce("q", F.lit(False)), "flagged": F.coalesce("x", F.lit(False))})
    hashed = staged.withColumn("semantic_hash", exprs.content_hash("doc_id", "title", "source"))
    return hashed.select("doc_id", "lang", "ready", "flagged", "flags", F.concat_ws(" ", "title", "source", "flags").alias("search_text"), "semantic_hash", exprs.content_hash("semantic_hash", "ready", "flagged", "flags").alias("content_hash"))


SEARCH = '"anea eriner" or "und der" or für den or thanea -casino'


@query(f"WITH {searching.search(SEARCH, FIELDS)} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM found ORDER BY score DESC, doc_id LIMIT 20")
def web_search(t) -> DataFrame:
    """A query with phrases, or, minus and stems, ranked by cover density."""
    return retrieval.ranked(fulltext.matches(search_index(t), SEARCH), "score", "doc_id", 20)
