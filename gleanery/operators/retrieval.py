"""Keyword and vector retrieval and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import clamp


def candidates(limit: int) -> int:
    """How many rows each branch hands on."""
    return max(200, min(limit * 20, 2000))


def ranked(df: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    """The first ``limit`` rows with their place; the window sees only those."""
    top = df.orderBy(F.desc(score), key).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), F.col(key))).cast("long"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector(vectors: DataFrame, query: list[float], key: str, limit: int, column: str = "embedding") -> DataFrame:
    """key, score, place by exact cosine similarity, rounded to 9 places.

    Null and zero vectors have no similarity and are left out; so is everything
    where the query is null or zero.
    """
    q = F.array(*[F.lit(float(x)) for x in query or ()])
    scored = vectors.select(F.col(key), F.round(cosine(F.col(column), q), 9).alias("score"))
    return ranked(scored.where(F.col("score").isNotNull()), "score", key, limit)


def fresh(embeddings: DataFrame, current: DataFrame, key: str, content_hash: str = "content_hash") -> DataFrame:
    """Embeddings made from the content that is current."""
    return embeddings.join(current.select(key, content_hash), [key, content_hash], "left_semi")


def fused(words: DataFrame, vectors: DataFrame, key: str, limit: int, k: int = 60, word_weight: float = 1.0, vector_weight: float = 0.55) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    w = words.select(key, F.col("place").alias("word_place"))
    v = vectors.select(key, F.col("place").alias("vector_place"))
    part = lambda c, x: F.coalesce(F.lit(x) / (F.lit(k) + F.col(c)), F.lit(0.0))
    score = F.round(part("word_place", word_weight) + part("vector_place", vector_weight), 9)
    return w.join(v, key, "full_outer").withColumn("score", score).orderBy(F.desc("score"), key).limit(clamp(limit, 20, 1, 2000))


# The names of the modes that were asked for and used.
def hybrid(words: DataFrame, vectors: DataFrame, key: str, limit: int, mode: str = "hybrid", base: DataFrame | None = None, **weights) -> DataFrame:
    """Fusion with the fallbacks: no vectors make hybrid a keyword search.

    ``base``: the table of which ``vectors`` are the nearest; to ask it for a row
    costs less than to search it.
    """
    has = bool((vectors if base is None else base).head(1)) if mode in ("hybrid", "vector") else False
    if mode == "keyword" or (mode == "hybrid" and not has):
        used = "keyword" if mode == "keyword" else "keyword_fallback"
        return words.select(key, F.col("place").alias("word_place"), F.lit(None).cast("long").alias("vector_place"), F.round(1.0 / (60 + F.col("place")), 9).alias("score"), F.lit(used).alias("mode")).orderBy("word_place").limit(limit)
    if mode == "vector":
        return vectors.select(key, F.lit(None).cast("long").alias("word_place"), F.col("place").alias("vector_place"), F.col("score"), F.lit(mode).alias("mode")).orderBy("vector_place").limit(limit)
    return fused(words, vectors, key, limit, **weights).withColumn("mode", F.lit(mode))
