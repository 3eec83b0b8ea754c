"""Snapshots, identity, validation and data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import exprs
from gleanery.operators import reconcile, snapshot

from .registry import query

V1 = "v1 AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS priority FROM orders WHERE o_orderkey % 23 <> 0)"
V2 = "v2 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS priority FROM orders WHERE o_orderkey % 17 <> 0)"
SAME = "v1.o_orderstatus IS NOT DISTINCT FROM v2.o_orderstatus AND v1.priority IS NOT DISTINCT FROM v2.priority"


def versions(t) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    rows = t("orders").select("o_orderkey", "o_orderstatus", F.when(k % 19 != 0, F.col("o_orderpriority")).alias("priority"))
    return rows.where(k % 23 != 0), rows.where(k % 17 != 0).withColumn("o_orderstatus", F.when(k % 13 == 0, "X").otherwise(F.col("o_orderstatus")))


@query(f"""
WITH {V1}, {V2} SELECT coalesce(v2.o_orderkey, v1.o_orderkey) AS o_orderkey, CASE WHEN v1.o_orderkey IS NULL THEN 'new' WHEN v2.o_orderkey IS NULL THEN 'removed' WHEN {SAME} THEN 'unchanged' ELSE 'changed' END AS state
FROM v1 FULL JOIN v2 ON v1.o_orderkey = v2.o_orderkey""")
def snapshot_diff(t) -> DataFrame:
    return snapshot.diff(*versions(t), ["o_orderkey"])


@query(f"""
WITH {V1}, {V2} SELECT coalesce(v2.o_orderkey, v1.o_orderkey) AS o_orderkey, CASE WHEN v2.o_orderkey IS NOT NULL THEN v2.o_orderstatus ELSE v1.o_orderstatus END AS o_orderstatus,
  CASE WHEN v2.o_orderkey IS NOT NULL THEN v2.priority ELSE v1.priority END AS priority,
  CASE WHEN v2.o_orderkey IS NOT NULL AND NOT (v1.o_orderkey IS NOT NULL AND {SAME}) THEN DATE '2024-02-01' WHEN v1.o_orderkey IS NOT NULL THEN DATE '2024-01-01' END AS changed_at
FROM v1 FULL JOIN v2 ON v1.o_orderkey = v2.o_orderkey""")
def upsert_changed_only(t) -> DataFrame:
    old, new = versions(t)
    return snapshot.upsert(old.withColumn("changed_at", F.lit("2024-01-01").cast("date")), new, ["o_orderkey"], "changed_at", F.lit("2024-02-01").cast("date"))


@query("""
WITH o AS (SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS k, min(o_totalprice) AS v FROM orders GROUP BY 1), n AS (SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS k, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.k IS NOT DISTINCT FROM n.k""")
def null_safe_key_upsert(t) -> DataFrame:
    rows = t("orders").withColumn("k", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")))
    return snapshot.upsert(rows.groupBy("k").agg(F.min("o_totalprice").alias("v")), rows.where("o_orderkey % 2 = 0").groupBy("k").agg(F.max("o_totalprice").alias("v")), ["k"])


@query("""
WITH o AS (SELECT p_partkey, p_size AS v, DATE '2024-01-01' AS at FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, p_size + 1 AS v, DATE '2024-02-01' AS at FROM part WHERE p_partkey % 3 = 0)
SELECT o.*, CASE WHEN b.p_partkey IS NOT NULL THEN b.at END AS valid_to, CASE WHEN b.p_partkey IS NOT NULL THEN 'superseded' ELSE 'current' END AS status FROM o LEFT JOIN b USING (p_partkey)
UNION ALL SELECT *, NULL, 'current' FROM b""")
def scd2_supersede(t) -> DataFrame:
    at = lambda d: F.lit(d).cast("date")
    old = t("part").where("p_partkey % 7 <> 0").select("p_partkey", F.col("p_size").alias("v"), at("2024-01-01").alias("at"), F.lit(None).cast("date").alias("valid_to"), F.lit("current").alias("status"))
    batch = t("part").where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_size") + 1).alias("v"), at("2024-02-01").alias("at"))
    return snapshot.supersede(old, batch, "p_partkey", "at")


@query("""
WITH h AS (SELECT sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus)) AS h FROM orders), a AS (SELECT substr(h, 1, 6) AS b, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1),
b AS (SELECT substr(b, 1, 3) AS b, sha256(string_agg(d, '' ORDER BY b, d)) AS d, sum(n) AS n FROM a GROUP BY 1)
SELECT sha256(string_agg(d, '' ORDER BY b)) AS digest, sum(n)::BIGINT AS n_rows FROM b""")
def table_digest(t) -> DataFrame:
    return snapshot.digest(t("orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


INCOMING = """
incoming AS (SELECT o_orderkey AS ord, nullif(CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('C', o_custkey) END, '') AS code, CASE WHEN o_orderkey % 31 <> 0 THEN o_orderpriority END AS title FROM orders),
k AS (SELECT *, coalesce('provider:' || lower(code), '') AS key, code IS NULL OR title IS NULL AS bad FROM incoming),
r AS (SELECT k.*, i.c_custkey AS by_code, s.c_custkey AS by_key, row_number() OVER (PARTITION BY bad, key ORDER BY ord) AS rn, arg_max(title, ord) OVER (PARTITION BY bad, key) AS last
  FROM k LEFT JOIN customer i ON concat('C', i.c_custkey) = code AND i.c_mktsegment <> 'BUILDING' LEFT JOIN customer s ON concat('provider:c', s.c_custkey) = key AND s.c_acctbal > 0),
o AS (SELECT ord, code, key, CASE WHEN NOT bad THEN last END AS title, CASE WHEN NOT bad THEN coalesce(coalesce(by_code, by_key)::VARCHAR, md5(key)) END AS entity_id,
  CASE WHEN bad THEN 'conflict' WHEN by_code IS NOT NULL THEN 'existing_by_identifier' WHEN by_key IS NOT NULL OR rn > 1 THEN 'existing_by_stable_key' ELSE 'created' END AS outcome FROM r)"""


def resolved(t) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t("orders").select(k.alias("ord"), exprs.clean(F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string")))).alias("code"), F.when(k % 31 != 0, F.col("o_orderpriority")).alias("title"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("provider:"), F.lower("code")), F.lit("")))
    ids = t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"), "c_mktsegment", "c_acctbal")
    return reconcile.resolve(rows, ids.where("c_mktsegment <> 'BUILDING'"), ids.where("c_acctbal > 0").select("id", F.concat(F.lit("provider:"), F.lower("code")).alias("key")))


@query(f"WITH {INCOMING} SELECT * FROM o")
def identity_resolution(t) -> DataFrame:
    return resolved(t)


@query(f"WITH {INCOMING} SELECT outcome, count(*) AS n, count(DISTINCT entity_id) AS entities FROM o GROUP BY 1")
def reconcile_counts(t) -> DataFrame:
    return resolved(t).groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"))


MAPPING = (("PROMO", "advanced", "mapped"), ("ECONOMY", "basic", "mapped"), ("STANDARD", None, "review_required"))


@query("""
WITH s AS (SELECT CASE WHEN p_partkey % 6 <> 0 THEN split_part(p_type, ' ', 1) END AS v FROM part)
SELECT coalesce(v, '') AS source_value, CASE v WHEN 'PROMO' THEN 'advanced' WHEN 'ECONOMY' THEN 'basic' END AS level, CASE WHEN v IS NULL THEN 'source_absent' WHEN v IN ('PROMO', 'ECONOMY') THEN 'mapped' WHEN v = 'STANDARD' THEN 'review_required' ELSE 'unmapped' END AS state, count(*) AS n FROM s GROUP BY ALL""")
def vocab_mapping(t) -> DataFrame:
    words = t("part").select(F.when(F.col("p_partkey") % 6 != 0, F.split_part("p_type", F.lit(" "), F.lit(1))).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    known = t("part").sparkSession.createDataFrame(MAPPING, "v string, level string, known string")
    state = F.when(F.col("v").isNull(), "source_absent").otherwise(F.coalesce("known", F.lit("unmapped")))
    return words.join(F.broadcast(known), "v", "left").select(F.coalesce("v", F.lit("")).alias("source_value"), "level", state.alias("state"), "n")  # three rows


@query("""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, role, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS id, length(text) AS n_chars
FROM (SELECT *, md5(concat('conv:', conv_id, ':turn:', turn)) AS h FROM conversations)""")
def nested_shred(t) -> DataFrame:
    nested = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = nested.select("conv_id", F.posexplode("turns").alias("place", "x"))
    name = F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit(":turn:"), F.col("x.turn").cast("string"))
    return rows.select("conv_id", (F.col("place") + 1).cast("long").alias("ord"), "x.role", exprs.md5_uuid(name).alias("id"), F.char_length("x.text").cast("long").alias("n_chars"))


@query("""
SELECT 'quantity_range' AS rule, l_orderkey * 10 + l_linenumber AS key FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 49 UNION ALL SELECT 'discount_and_tax', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_discount > 0.08 AND l_tax > 0.06
UNION ALL SELECT 'no_customer', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)""")
def validation_errors(t) -> DataFrame:
    lines = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_quantity", "l_discount", "l_tax")
    failed = F.filter(F.array(F.when(~F.col("l_quantity").between(1, 49), "quantity_range"), F.when((F.col("l_discount") > 0.08) & (F.col("l_tax") > 0.06), "discount_and_tax")), lambda x: x.isNotNull())
    orphans = t("orders").join(t("customer").where("c_custkey % 50 <> 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return lines.select(F.explode(failed).alias("rule"), "key").unionByName(orphans.select(F.lit("no_customer").alias("rule"), F.col("o_orderkey").alias("key")))


@query("""
SELECT 'nations' AS check_name, 25 AS expected, count(*) AS actual, count(*) = 25 AS ok FROM nation UNION ALL SELECT 'parts_floor', 1000000, count(*), count(*) >= 1000000 FROM part
UNION ALL SELECT 'orders_in_lines', (SELECT count(*) FROM orders), count(DISTINCT l_orderkey), count(DISTINCT l_orderkey) <= (SELECT count(*) FROM orders) FROM lineitem""")
def expectation_gate(t) -> DataFrame:
    long = lambda x: x.cast("long")
    row = lambda df, name, expected, actual, ok: df.select(F.lit(name).alias("check_name"), long(expected).alias("expected"), long(actual).alias("actual"), ok.alias("ok"))
    a = F.col("a")
    nations, parts = t("nation").agg(F.count("*").alias("a")), t("part").agg(F.count("*").alias("a"))
    lines = t("lineitem").agg(F.countDistinct("l_orderkey").alias("a")).crossJoin(t("orders").agg(F.count("*").alias("e")))
    return reduce(DataFrame.unionByName, [row(nations, "nations", F.lit(25), a, a == 25), row(parts, "parts_floor", F.lit(1000000), a, a >= 1000000), row(lines, "orders_in_lines", F.col("e"), a, a <= F.col("e"))])


@query("""
SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'active' WHEN bool_or(o_orderstatus = 'P') THEN 'suspended' WHEN bool_or(o_orderstatus = 'F') THEN 'inactive' ELSE 'unknown' END AS lifecycle FROM orders GROUP BY 1""")
def lifecycle_precedence(t) -> DataFrame:
    has = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    return t("orders").groupBy("o_custkey").agg(F.when(has("O"), "active").when(has("P"), "suspended").when(has("F"), "inactive").otherwise("unknown").alias("lifecycle"))


STATE = "CASE WHEN p_size % 10 = 0 THEN 'not_applicable' WHEN p_partkey % 8 = 0 THEN 'source_null' WHEN p_partkey % 9 = 0 THEN 'zero' WHEN p_partkey % 21 = 0 THEN 'suppressed' ELSE 'present' END"


def states(t) -> DataFrame:
    k = F.col("p_partkey")
    state = F.when(F.col("p_size") % 10 == 0, "not_applicable").when(k % 8 == 0, "source_null").when(k % 9 == 0, "zero").when(k % 21 == 0, "suppressed").otherwise("present")
    return t("part").select("p_partkey", "p_brand", state.alias("state"))


@query(f"SELECT p_brand, {STATE} AS state, count(*) AS n FROM part GROUP BY ALL")
def state_matrix(t) -> DataFrame:
    return states(t).groupBy("p_brand", "state").agg(F.count("*").alias("n"))


READY = "round(100.0 * count(*) FILTER (WHERE state IN ('present', 'zero')) / nullif(count(*) FILTER (WHERE state <> 'not_applicable'), 0), 2)::DOUBLE"


def readiness(*keys: str):
    ready, scope = F.count_if(F.col("state").isin("present", "zero")), F.count_if(F.col("state") != "not_applicable")
    return F.round(100.0 * ready / F.nullif(scope, F.lit(0)), 2).alias("readiness_pct")


@query(f"SELECT p_brand, {READY} AS readiness_pct FROM (SELECT p_brand, {STATE} AS state FROM part) GROUP BY 1")
def readiness_pct(t) -> DataFrame:
    return states(t).groupBy("p_brand").agg(readiness())


@query(f"""
WITH s AS (SELECT p_brand, {STATE} AS state FROM part), x AS (SELECT 'all' AS scope, state FROM s UNION ALL SELECT p_brand, state FROM s WHERE p_brand IN (SELECT min(p_brand) FROM part UNION SELECT max(p_brand) FROM part))
SELECT scope, count(*) AS n_rows, {READY} AS readiness_pct FROM x GROUP BY 1""")
def scope_snapshots(t) -> DataFrame:
    rows = states(t)
    ends = rows.agg(F.array(F.min("p_brand"), F.max("p_brand")).alias("ends"))
    named = rows.crossJoin(F.broadcast(ends)).where(F.array_contains("ends", F.col("p_brand")))  # one row
    both = rows.select(F.lit("all").alias("scope"), "state").unionByName(named.select(F.col("p_brand").alias("scope"), "state"))
    return both.groupBy("scope").agg(F.count("*").alias("n_rows"), readiness())


@query("""
SELECT user_id, max(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END)::BIGINT AS role_rank FROM events WHERE event_id % 4 <> 0 OR ts > TIMESTAMP '2024-01-15' GROUP BY 1""")
def effective_role(t) -> DataFrame:
    e = F.col("event_type")
    rank = F.when(e == "signup", 1).when(e == "view", 2).when(e == "click", 3).when(e == "purchase", 4).otherwise(0)
    live = t("events").where((F.col("event_id") % 4 != 0) | (F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz")))
    return live.groupBy("user_id").agg(F.max(rank).cast("long").alias("role_rank"))
