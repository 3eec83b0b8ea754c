"""Keys, parsing and semi-structured values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import exprs
from gleanery.operators import serve

from .registry import query

NS = exprs.URL_NAMESPACE


@query("SELECT c_custkey, concat('provider:au:', regexp_replace(lower(regexp_replace(concat(' ', c_name, '/', c_mktsegment, '!'), '[^a-zA-Z0-9]+', '-', 'g')), '^-+|-+$', '', 'g')) AS stable_key FROM customer")
def stable_key_slug(t) -> DataFrame:
    raw = F.concat(F.lit(" "), "c_name", F.lit("/"), "c_mktsegment", F.lit("!"))
    return t("customer").select("c_custkey", F.concat(F.lit("provider:au:"), exprs.slug(raw)).alias("stable_key"))


@query(f"""
SELECT p_partkey, concat(h[1:8], '-', h[9:12], '-', printf('%02x', (('0x' || h[13:14])::INT & 15) | 80), h[15:16], '-', printf('%02x', (('0x' || h[17:18])::INT & 63) | 128), h[19:20], '-', h[21:32]) AS id
FROM (SELECT p_partkey, sha1(unhex('{NS}') || encode(concat('course:', p_partkey))) AS h FROM part)""")
def uuid_v5_keys(t) -> DataFrame:
    return t("part").select("p_partkey", exprs.uuid_v5(F.concat(F.lit("course:"), F.col("p_partkey").cast("string"))).alias("id"))


@query("SELECT p_partkey, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS id FROM (SELECT p_partkey, md5(concat('part:', p_partkey, ':', p_name)) AS h FROM part)")
def md5_uuid_keys(t) -> DataFrame:
    return t("part").select("p_partkey", exprs.md5_uuid(F.concat(F.lit("part:"), F.col("p_partkey").cast("string"), F.lit(":"), "p_name")).alias("id"))


@query("SELECT p_partkey, sha256(concat_ws('|', '=' || p_name, coalesce('=' || CASE WHEN p_partkey % 5 <> 0 THEN p_brand END, '~'), '=' || p_size)) AS content_hash FROM part")
def content_hash(t) -> DataFrame:
    rows = t("part").withColumn("brand", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")))
    return rows.select("p_partkey", exprs.content_hash("p_name", "brand", "p_size").alias("content_hash"))


@query("""
SELECT raw, v AS value, count(*) AS n FROM (SELECT raw, CASE WHEN lower(trim(raw)) IN ('yes', 'true', 'y', '1') THEN true WHEN lower(trim(raw)) IN ('no', 'false', 'n', '0') THEN false END AS v
  FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN ' YES ' WHEN 1 THEN 'n' WHEN 2 THEN 'maybe' WHEN 3 THEN '1' WHEN 4 THEN '' END AS raw FROM orders)) GROUP BY ALL""")
def tri_state_bool(t) -> DataFrame:
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, " YES ").when(k == 1, "n").when(k == 2, "maybe").when(k == 3, "1").when(k == 4, "")
    return t("orders").select(raw.alias("raw")).withColumn("value", exprs.tri_state(F.col("raw"))).groupBy("raw", "value").agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 67400 ELSE p_size END::DOUBLE AS value, CASE WHEN p_partkey % 4 = 0 THEN p_size - 1 END::DOUBLE AS low, CASE WHEN p_partkey % 4 = 0 THEN p_size + 2 END::DOUBLE AS high FROM part""")
def ci_cell_parse(t) -> DataFrame:
    k, s = F.col("p_partkey") % 4, F.col("p_size")
    wide = F.concat(s.cast("string"), F.lit(".5 ("), (s - 1).cast("string"), F.lit(".0, "), (s + 2).cast("string"), F.lit(".0)"))
    cell = F.when(k == 0, wide).when(k == 1, "67,400").when(k == 2, "n/a").otherwise(s.cast("string"))
    value, low, high = exprs.interval_cell(F.col("cell"))
    return t("part").select("p_partkey", cell.alias("cell")).select("p_partkey", value.alias("value"), low.alias("low"), high.alias("high"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 1234 ELSE o_orderkey % 100 END::BIGINT AS count_value, o_orderkey % 3 = 0 AS is_suppressed FROM orders")
def suppressed_count(t) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "<5").when(k % 3 == 1, " 1,234 ").otherwise((k % 100).cast("string"))
    count, hidden = exprs.suppressed(F.col("raw"))
    return t("orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", count.alias("count_value"), hidden.alias("is_suppressed"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, make_date(year(o_orderdate), 1, 1) AS period_start, last_day(o_orderdate::DATE) AS period_end FROM orders")
def period_parse(t) -> DataFrame:
    line = F.concat(F.lit("Students, Year-to-date "), F.date_format("o_orderdate", "MMMM yyyy"))
    found = t("orders").select(line.alias("x")).distinct().select(F.to_date(F.concat(F.lit("1 "), F.regexp_extract("x", r"Year-to-date (\w+ \d{4})", 1)), "d MMMM yyyy").alias("d"))
    return found.select(F.date_format("d", "yyyy-MM").alias("month"), F.trunc("d", "year").alias("period_start"), F.last_day("d").alias("period_end"))


@query("""
SELECT p_type, CASE WHEN p_type LIKE '%PROMO%' THEN 'certificate' WHEN p_type LIKE '%ECONOMY%' THEN 'diploma' WHEN p_type LIKE '%STANDARD%' THEN 'bachelor' WHEN p_type LIKE '%MEDIUM%' THEN 'master'
  WHEN p_type LIKE '%LARGE%' OR p_type LIKE '%SMALL%' THEN 'doctorate' ELSE 'other' END AS level, count(*) AS n FROM part GROUP BY ALL""")
def level_classifier(t) -> DataFrame:
    return t("part").groupBy("p_type").agg(F.count("*").alias("n")).withColumn("level", exprs.level(F.col("p_type")))


@query("""
SELECT doc_id, trim(regexp_replace(strip_accents(lower(replace(concat(text, ' & Co.'), '&', ' and '))), '[^a-z0-9]+', ' ', 'g')) AS label FROM documents""")
def normalise_label(t) -> DataFrame:
    return t("documents").select("doc_id", exprs.label(F.concat("text", F.lit(" & Co."))).alias("label"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z FROM events")
def json_extract(t) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    has = lambda k: F.array_contains(F.map_keys(m), k)
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), has("k").alias("has_k"), has("z").alias("has_z"))


@query("""SELECT event_id, concat('{"type":"', event_type, '","k":"', props->>'$.k', '"}') AS safe FROM events""")
def json_redact(t) -> DataFrame:
    full = F.to_json(F.struct(F.lit("s3cret").alias("token"), F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("type")))
    return t("events").select("event_id", serve.redacted(full, ["type", "k", "missing"]).alias("safe"))


@query(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS visible FROM pages""")
def html_visible_text(t) -> DataFrame:
    return t("pages").select("page_id", exprs.visible_text(F.col("html")).alias("visible"))


@query("SELECT page_id, contains(lower(html), 'the ') AND contains(lower(html), '</html>') AND contains(lower(html), 'utf-8') AS proven FROM pages")
def proof_phrases(t) -> DataFrame:
    phrases = F.array(*[F.lit(p) for p in ("The ", "</html>", "UTF-8")])
    return t("pages").select("page_id", F.forall(phrases, lambda p: F.contains(F.lower("html"), F.lower(p))).alias("proven"))


@query("""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"#?]*)', 1)) AS link FROM pages""")
def link_discovery(t) -> DataFrame:
    """Distinct links of each page without query and fragment."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"#?]*)'), F.lit(1)))
    return t("pages").select("page_id", F.explode(links).alias("link"))
