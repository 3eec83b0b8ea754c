"""A regulator's snapshot of courses, and scoped reconciliation, each counted and applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import exprs
from gleanery.operators import regulatory, scoped

from .registry import query

AT, BEFORE = "2024-02-01", "2024-01-01"
HASH = "sha256(concat_ws('|', coalesce('=' || dual, '~'), coalesce('=' || hours, '~'), coalesce('=' || language, '~')))"
SNAPSHOT = f"""
raw AS (SELECT o_orderkey AS k, o_totalprice::DECIMAL(18,2) AS price, o_orderpriority AS p, CASE o_orderpriority WHEN '1-URGENT' THEN 'Yes' WHEN '2-HIGH' THEN 'n' WHEN '5-LOW' THEN 'maybe' END AS dual_raw,
  CASE WHEN o_orderkey % 5 = 0 THEN '12.' WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 40)::VARCHAR END AS hours_raw, o_orderstatus AS language FROM orders),
r AS (SELECT *, CASE WHEN price < 300000 THEN k END AS course_id, CASE dual_raw WHEN 'Yes' THEN true WHEN 'n' THEN false END AS dual, CASE WHEN regexp_full_match(hours_raw, '[0-9]+([.][0-9]+)?') THEN hours_raw::DECIMAL(18,2) END AS hours FROM raw),
h AS (SELECT *, {HASH} AS hash FROM r),
g AS (SELECT course_id, fee_type, raw, CASE WHEN regexp_full_match(regexp_replace(raw, '[^0-9.-]', '', 'g'), '-?[0-9]+([.][0-9]+)?') THEN regexp_replace(raw, '[^0-9.-]', '', 'g')::DECIMAL(18,2) END AS amount, 'cricos:c' || k || ':' || fee_type || ':{AT}' AS source_fee_key
  FROM (SELECT *, unnest(['tuition', 'non_tuition', 'estimated_total_course_cost']) AS fee_type, unnest([CASE WHEN k % 3 = 0 THEN 'n/a' ELSE 'AUD ' || price END, CASE WHEN k % 4 <> 0 THEN (k % 1000) || '.50' END, '$' || k]) AS raw FROM h) WHERE course_id IS NOT NULL),
o AS (SELECT k AS course_id, DATE '{BEFORE}' AS snapshot_at, hash AS content_hash, 'current' AS status, NULL::DATE AS valid_to FROM h WHERE price < 150000
  UNION ALL SELECT k, DATE '{AT}', CASE WHEN p = '5-LOW' THEN 'x' ELSE hash END, 'current', NULL FROM h WHERE price BETWEEN 100000 AND 120000),
f AS (SELECT k AS course_id, 'tuition' AS fee_type, 'cricos:c' || k || ':tuition:{BEFORE}' AS source_fee_key, price AS amount, DATE '{BEFORE}' AS snapshot_at, 'active' AS status, NULL::DATE AS valid_to FROM h WHERE price < 150000
  UNION ALL SELECT k, 'tuition', 'cricos:c' || k || ':tuition:{AT}', CASE WHEN p = '5-LOW' THEN 1 ELSE price END, DATE '{AT}', 'active', NULL FROM h WHERE price BETWEEN 100000 AND 120000)"""


def snapshot(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Matched rows, the grid of fees, the observations and the fees that are there."""
    k, price, p = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderpriority")
    text = lambda c: c.cast("string")
    codes = [F.concat(F.lit(" p"), text(F.col("o_custkey"))).alias("provider_code"), F.concat(F.lit("c"), text(k)).alias("course_code")]
    records = t("orders").select(
        k.alias("ord"),
        *codes,
        F.when(p == "1-URGENT", "Yes").when(p == "2-HIGH", "n").when(p == "5-LOW", "maybe").alias("dual_raw"),
        F.when(k % 5 == 0, "12.").when(k % 3 == 0, text(k % 40)).alias("hours_raw"),
        F.col("o_orderstatus").alias("language"),
        F.when(k % 3 == 0, "n/a").otherwise(F.concat(F.lit("AUD "), text(price))).alias("tuition_raw"),
        F.when(k % 4 != 0, F.concat(text(k % 1000), F.lit(".50"))).alias("non_tuition_raw"),
        F.concat(F.lit("$"), text(k)).alias("total_raw"),
    )
    courses = t("orders").where(price < 300000).select(F.concat(F.lit("P"), text(F.col("o_custkey"))).alias("provider_code"), F.concat(F.lit("C"), text(k)).alias("course_code"), k.alias("course_id"))
    rows = regulatory.matched(regulatory.parsed(records), courses)
    hashes = t("orders").select(k.alias("course_id"), price.alias("price"), p.alias("p")).join(regulatory.parsed(records).select(F.substring("course_code", 2, 20).cast("long").alias("course_id"), "fact_hash"), "course_id")
    was = F.col("price").between(100000, 120000)
    day = lambda d: F.lit(d).cast("date")
    none = F.lit(None).cast("date").alias("valid_to")
    observed = hashes.where("price < 150000").select("course_id", day(BEFORE).alias("snapshot_at"), F.col("fact_hash").alias("content_hash"), F.lit("current").alias("status"), none)
    observed = observed.unionByName(hashes.where(was).select("course_id", day(AT).alias("snapshot_at"), F.when(F.col("p") == "5-LOW", "x").otherwise(F.col("fact_hash")).alias("content_hash"), F.lit("current").alias("status"), none))
    fee = lambda at, amount: [F.col("course_id"), F.lit("tuition").alias("fee_type"), F.concat(F.lit("cricos:c"), text(F.col("course_id")), F.lit(f":tuition:{at}")).alias("source_fee_key"), amount.cast("decimal(18,2)").alias("amount"), day(at).alias("snapshot_at"), F.lit("active").alias("status"), none]
    fees = hashes.where("price < 150000").select(*fee(BEFORE, F.col("price"))).unionByName(hashes.where(was).select(*fee(AT, F.when(F.col("p") == "5-LOW", 1).otherwise(F.col("price")))))
    return rows, regulatory.fee_grid(rows, "cricos", AT), observed, fees


@query(f"""
WITH {SNAPSHOT}, x AS (
SELECT 'fact' AS kind, CASE WHEN o.status IS NULL THEN 'created' WHEN o.content_hash <> hash THEN 'updated' ELSE 'unchanged' END AS outcome FROM h LEFT JOIN o ON o.course_id = h.course_id AND snapshot_at = DATE '{AT}' WHERE h.course_id IS NOT NULL
UNION ALL SELECT 'fact', 'superseded' FROM o WHERE snapshot_at <> DATE '{AT}' AND course_id IN (SELECT course_id FROM h WHERE course_id IS NOT NULL)
UNION ALL SELECT 'fee', CASE WHEN f.status IS NULL THEN 'created' WHEN f.amount <> g.amount THEN 'updated' ELSE 'unchanged' END FROM g LEFT JOIN f USING (course_id, source_fee_key) WHERE g.amount IS NOT NULL
UNION ALL SELECT 'fee', 'superseded' FROM f WHERE snapshot_at <> DATE '{AT}' AND (course_id, fee_type) IN (SELECT course_id, fee_type FROM g)
UNION ALL SELECT 'record', 'course_missing' FROM h WHERE course_id IS NULL UNION ALL SELECT 'record', 'invalid_boolean' FROM h WHERE dual_raw IS NOT NULL AND dual IS NULL UNION ALL SELECT 'record', 'invalid_number' FROM h WHERE hours_raw IS NOT NULL AND hours IS NULL
UNION ALL SELECT 'fee', 'invalid' FROM g WHERE raw IS NOT NULL AND amount IS NULL)
SELECT kind, outcome, count(*) AS n FROM x GROUP BY ALL""")
def regulatory_counts(t) -> DataFrame:
    """The dry run of a snapshot: facts, fees and what is wrong with records."""
    return regulatory.counted(*snapshot(t), AT)


@query(f"""
WITH {SNAPSHOT} SELECT course_id, snapshot_at, content_hash, CASE WHEN course_id IN (SELECT course_id FROM h WHERE course_id IS NOT NULL) THEN 'superseded' ELSE status END AS status, CASE WHEN course_id IN (SELECT course_id FROM h WHERE course_id IS NOT NULL) THEN DATE '{AT}' END AS valid_to FROM o WHERE snapshot_at <> DATE '{AT}'
UNION ALL SELECT course_id, DATE '{AT}', hash, 'current', NULL FROM h WHERE course_id IS NOT NULL""")
def regulatory_observations(t) -> DataFrame:
    """Observations after the snapshot, applied twice: the replay changes nothing."""
    rows, _, observed, _ = snapshot(t)
    return regulatory.observed_after(rows, regulatory.observed_after(rows, observed, AT), AT)


@query(f"""
WITH {SNAPSHOT} SELECT course_id, fee_type, source_fee_key, amount, snapshot_at, 'superseded' AS status, DATE '{AT}' AS valid_to FROM f WHERE snapshot_at <> DATE '{AT}'
UNION ALL SELECT course_id, fee_type, source_fee_key, amount, snapshot_at, status, NULL FROM f WHERE snapshot_at = DATE '{AT}' AND source_fee_key NOT IN (SELECT source_fee_key FROM g WHERE amount IS NOT NULL)
UNION ALL SELECT course_id, fee_type, source_fee_key, amount, DATE '{AT}', 'active', NULL FROM g WHERE amount IS NOT NULL""")
def regulatory_fees(t) -> DataFrame:
    """Fees after the snapshot: unpivoted, superseded and upserted by key, applied twice."""
    _, grid, _, fees = snapshot(t)
    return regulatory.fees_after(grid, regulatory.fees_after(grid, fees, AT), AT)


SCOPED = """
r AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'O' || l_suppkey AS provider_code, CASE WHEN l_linenumber < 7 THEN 'Provider ' || l_suppkey END AS provider_name, CASE WHEN l_quantity > 1 THEN 'L' || l_partkey END AS course_code, 'Course ' || l_partkey || ' ' || l_linenumber AS title,
  CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'R' THEN 'suspended' WHEN 'N' THEN CASE WHEN l_linenumber = 1 THEN 'closed' ELSE 'unknown' END END AS lifecycle, CASE WHEN l_tax > 0.04 THEN 'cip' END AS reg_scheme, 'R' || l_partkey % 100 AS reg_code FROM lineitem),
ok AS (SELECT *, 'provider:ca:ircc_dli:' || lower(provider_code) AS provider_key, 'course:ca:ircc_dli:' || lower(provider_code) || ':local:' || lower(course_code) AS course_key FROM r WHERE lifecycle IN ('active', 'suspended', 'inactive', 'unknown') AND provider_name IS NOT NULL AND course_code IS NOT NULL),
pi AS (SELECT 'O' || s_suppkey AS code, 'p' || s_suppkey AS id FROM supplier WHERE s_acctbal > 0),
p AS (SELECT provider_key, provider_code, coalesce(any_value(id), md5(provider_key)) AS provider_id, any_value(id) IS NOT NULL AS known, count(*) AS n FROM ok LEFT JOIN pi ON code = provider_code GROUP BY 1, 2),
c AS (SELECT course_key, provider_code, course_code, arg_max(title, ord) AS title, arg_max(lifecycle, ord) AS lifecycle, count(*) AS n FROM ok GROUP BY ALL)"""


def scoped_batch(t) -> tuple[DataFrame, DataFrame]:
    s = lambda c: F.col(c).cast("string")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    records = t("lineitem").select(
        (F.col("l_orderkey") * 10 + line).alias("ord"),
        F.concat(F.lit(" o"), s("l_suppkey")).alias("provider_code"),
        F.when(line < 7, F.concat(F.lit("Provider "), s("l_suppkey"))).alias("provider_name"),
        F.when(F.col("l_quantity") > 1, F.concat(F.lit("L"), s("l_partkey"))).alias("course_code"),
        F.concat_ws(" ", F.lit("Course"), s("l_partkey"), s("l_linenumber")).alias("title"),
        F.when(flag == "A", " ").when(flag == "R", "Suspended").when(flag == "N", F.when(line == 1, "closed").otherwise("unknown")).alias("lifecycle"),
        F.when(F.col("l_tax") > 0.04, "CIP").alias("reg_scheme"),
        F.concat(F.lit("R"), (F.col("l_partkey") % 100).cast("string")).alias("reg_code"),
    )
    known = t("supplier").where("s_acctbal > 0").select(F.concat(F.lit("O"), s("s_suppkey")).alias("code"), F.concat(F.lit("p"), s("s_suppkey")).alias("id"))
    return records, known


@query(f"""
WITH {SCOPED}, x AS (SELECT 'conflicts' AS name, (SELECT count(*) FROM r) - (SELECT count(*) FROM ok) AS n UNION ALL SELECT 'records', count(*) FROM r
UNION ALL SELECT 'provider_created', count(*) FILTER (WHERE NOT known) FROM p UNION ALL SELECT 'provider_existing', sum(n)::BIGINT - count(*) FILTER (WHERE NOT known) FROM p
UNION ALL SELECT 'course_created', count(*) FROM c UNION ALL SELECT 'course_existing', sum(n)::BIGINT - count(*) FROM c
UNION ALL SELECT 'lifecycle_' || v, (SELECT count(*) FROM ok WHERE lifecycle = v) FROM (VALUES ('active'), ('suspended'), ('inactive'), ('unknown')) l(v)) SELECT name, coalesce(n, 0)::BIGINT AS n FROM x""")
def scoped_counts(t) -> DataFrame:
    """What a scoped batch of courses would do, record by record."""
    records, known = scoped_batch(t)
    return scoped.tallied(records, "CA", "ircc_dli", "local", known)


@query(f"""
WITH {SCOPED}, i AS (SELECT 'course_identifier' AS relation, course_key AS owner, 'local' AS scheme, course_code AS code FROM c UNION ALL SELECT 'provider_identifier', provider_id, 'ircc_dli', provider_code FROM p UNION ALL SELECT 'provider_registration', provider_id, 'ircc_dli', provider_code FROM p
UNION ALL SELECT DISTINCT 'course_registration', course_key, reg_scheme, reg_code FROM ok WHERE reg_scheme IS NOT NULL) SELECT * FROM i""")
def scoped_identifiers(t) -> DataFrame:
    """Identifiers and registrations that a scoped batch leaves, one row each."""
    records, known = scoped_batch(t)
    return scoped.identifiers(scoped.reconciled(records, "CA", "ircc_dli", "local", known), "ircc_dli", "local")


@query(f"WITH {SCOPED} SELECT c.course_key, p.provider_id, c.course_code, c.title, c.lifecycle FROM c JOIN p USING (provider_code)")
def scoped_courses(t) -> DataFrame:
    """Courses after a scoped batch: the last title and lifecycle of each win; ids are name-based."""
    records, known = scoped_batch(t)
    rows = scoped.courses(scoped.reconciled(records, "CA", "ircc_dli", "local", known))
    same = exprs.uuid_v5(F.concat_ws(":", F.lit("coursefinder"), F.lit("ca"), F.lower("provider_code"), F.lit("local"), F.lower("course_code")))
    return rows.where(F.col("course_id") == same).select("course_key", "provider_id", "course_code", "title", "lifecycle")
