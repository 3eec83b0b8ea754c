"""Pages, facets, metrics and quality reads that callers ask for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import filters, pages, reconcile, serve

from .registry import query

ENTITIES = """
e AS (SELECT p_partkey AS id, p_name AS title, p_brand AS provider, split_part(p_type, ' ', 1) AS level, split_part(p_type, ' ', 2) AS field, p_retailprice AS price, p_size AS score, coalesce(fee, false) AS has_fee, coalesce(late, false) AS has_intake
  FROM part LEFT JOIN (SELECT l_partkey, bool_or(l_discount > 0.09) AS fee, bool_or(l_shipdate >= TIMESTAMP '1998-01-01') AS late FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""


def entities(t) -> DataFrame:
    flags = t("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.bool_or(F.col("l_discount") > 0.09).alias("has_fee"), F.bool_or(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("has_intake"))
    word = lambda n: F.split_part("p_type", F.lit(" "), F.lit(n))
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("provider"), word(1).alias("level"), word(2).alias("field"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("score"))
    return rows.join(flags, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_fee", "has_intake")})


@query(f"""
WITH {ENTITIES}, f AS (SELECT * FROM e WHERE has_intake AND score >= 5 AND level IN (SELECT DISTINCT split_part(p_type, ' ', 1) FROM part) AND contains(lower(concat_ws(' ', title, provider)), 'brand'))
SELECT id, title, price, (SELECT count(*) FROM f) AS total FROM f ORDER BY price DESC NULLS LAST, id LIMIT 25 OFFSET 5""")
def entity_page(t) -> DataFrame:
    """All filters of an entity page, those not asked for left out; a page and its total."""
    none = dict.fromkeys(("country", "subdivision", "field", "delivery", "lifecycle", "publication", "status", "provider"))
    found = pages.entity_page(entities(t), equal=none, flags={"has_fee": None, "has_intake": True, "has_english": None}, text="BRAND", text_columns=("title", "provider"), least={"score": 5, "freshness": None}, sort="price", key="id", descending=True, limit=25, offset=5)
    return found.select("id", "title", "price", "total")


@query("""
SELECT o_orderstatus, o_orderpriority, l_returnflag, count(*) AS n, sum(l_quantity)::DECIMAL(18,2) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND year(o_orderdate) = 1996 AND l_returnflag = 'N' GROUP BY ALL""")
def outcome_filters(t) -> DataFrame:
    """Filters by metric, status and year; the tri-state one is asked for."""
    orders = filters.where(t("orders"), o_orderstatus=None, o_orderpriority=["1-URGENT", "5-LOW"]).where(F.year("o_orderdate") == 1996)
    lines = filters.where(t("lineitem"), l_returnflag="N", l_linestatus=None)
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus", "o_orderpriority", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("decimal(18,2)").alias("total"))


@query("""
WITH e AS (SELECT page_id, sha256(html) AS hash, split_part(split_part(url, '://', 2), '/', 1) AS host, contains(url, 'utm_') AS tracked FROM pages),
f AS (SELECT * FROM e WHERE hash[1:1] IN ('0', '1', '2', '3') AND page_id BETWEEN 0 AND 1000000 AND NOT tracked)
SELECT page_id, hash, host, (SELECT count(*) FROM f) AS total FROM f ORDER BY hash, page_id LIMIT 50""")
def evidence_page(t) -> DataFrame:
    """Evidence by hash prefix, range and flag."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    rows = t("pages").select("page_id", F.sha2("html", 256).alias("hash"), host.alias("host"), F.contains("url", F.lit("utm_")).alias("tracked"))
    prefix = reduce(lambda a, b: a | b, [F.col("hash").startswith(x) for x in "0123"])
    found = rows.where(pages.anded([prefix, F.col("page_id").between(0, 1000000), pages.asked(False, lambda v: F.col("tracked") == v), pages.asked(None, lambda v: F.col("host") == v)]))
    return filters.page(found.drop("tracked"), [F.col("hash"), F.col("page_id")], 50).crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


@query("""
SELECT c_mktsegment AS code, count(*) AS n, c_mktsegment = 'BUILDING' AS selected FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = (SELECT min(n_name) FROM nation) GROUP BY ALL""")
def dependent_facet(t) -> DataFrame:
    first = t("nation").agg(F.min("n_name").alias("n_name"))
    rows = t("customer").join(t("nation").join(first, "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return pages.dependent_facet(rows, "n_name", None, "c_mktsegment", "BUILDING")


@query("SELECT o_custkey, count(*) AS n, CASE WHEN count(*) <= 12 THEN string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) END AS items FROM orders GROUP BY 1")
def inline_list(t) -> DataFrame:
    """Orders listed in a row only where there are few."""
    return pages.bounded_list(t("orders"), ["o_custkey"], "o_orderkey", 12)


@query("""
WITH f AS (SELECT event_id, ts, event_type, user_id FROM events WHERE event_type IN ('error', 'view') AND value > 10) SELECT event_id, event_type, user_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts DESC NULLS LAST, event_id LIMIT 40""")
def jobs_page(t) -> DataFrame:
    rows = t("events").where("value > 10")
    return pages.entity_page(rows, equal={"event_type": ["error", "view"], "layer": None, "mode": None, "country": None}, sort="ts", key="event_id", descending=True, limit=40).select("event_id", "event_type", "user_id", "total")


@query("""
SELECT user_id, count(*) AS discovered, count(*) FILTER (WHERE event_type <> 'error') AS accepted, count(*) FILTER (WHERE event_type = 'error') AS rejected, count(*) FILTER (WHERE event_type = 'signup') AS creates, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS unchanged,
  greatest(count(*) - count(*) FILTER (WHERE event_type = 'error') - count(*) FILTER (WHERE event_type = 'signup') - count(*) FILTER (WHERE event_type IN ('view', 'click')), 0) AS other, (epoch(max(ts)) - epoch(min(ts)))::BIGINT AS seconds, max(event_id) AS resume_at FROM events GROUP BY 1""")
def run_metrics(t) -> DataFrame:
    kind = F.col("event_type")
    of = lambda c: F.count_if(c).cast("long")
    counts = t("events").groupBy("user_id").agg(
        F.count("*").alias("discovered"), of(kind != "error").alias("accepted"), of(kind == "error").alias("rejected"), of(kind == "signup").alias("creates"), of(kind.isin("view", "click")).alias("unchanged"),
        (F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")).alias("s"), F.max("event_id").alias("resume_at"),
    )
    return counts.withColumn("other", pages.residual([F.col("rejected"), F.col("creates"), F.col("unchanged")], F.col("discovered"))).withColumn("seconds", F.round("s").cast("long")).drop("s")


@query("""
SELECT o_custkey, count(*) AS total, least(100, round(100.0 * least(count(*) FILTER (WHERE o_orderstatus <> 'O'), count(*)) / count(*)))::BIGINT AS percent FROM orders GROUP BY 1""")
def progress_percent(t) -> DataFrame:
    done = F.least(F.count_if(F.col("o_orderstatus") != "O"), F.count("*"))
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.least(F.lit(100), F.round(F.lit(100.0) * done / F.count("*"))).cast("long").alias("percent"))


@query("""
SELECT event_type AS domain, arg_min(user_id, event_id) AS first_user, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def metrics_by_domain(t) -> DataFrame:
    """Groups with the attributes seen first."""
    return t("events").groupBy(F.col("event_type").alias("domain")).agg(F.min_by("user_id", "event_id").alias("first_user"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


# Field states. The order of the rules is that of the words below.
STATES = ("rejected", "ambiguous", "stale", "not_applicable", "not_yet_enriched", "suppressed", "source_null", "zero", "present")
RULES = ("p_retailprice < 905", "p_type LIKE '% BRUSHED %'", "p_type LIKE 'PROMO %'", "p_size > 45", "p_size BETWEEN 41 AND 45", "p_size BETWEEN 37 AND 40", "p_size BETWEEN 33 AND 36", "p_size < 3", "true")
STATE = "CASE " + " ".join(f"WHEN {r} THEN '{s}'" for s, r in zip(STATES, RULES)) + " END"


def field_states(t) -> DataFrame:
    return t("part").select("p_partkey", "p_brand", "p_name", reduce(lambda c, x: c.when(F.expr(x[1]), x[0]), list(zip(STATES, RULES))[1:], F.when(F.expr(RULES[0]), STATES[0])).alias("state"))


@query(f"SELECT p_brand, {', '.join(f'count(*) FILTER (WHERE s = {chr(39)}{x}{chr(39)}) AS {x}' for x in STATES)}, count(*) AS total FROM (SELECT p_brand, {STATE} AS s FROM part) GROUP BY 1")
def nine_states(t) -> DataFrame:
    """Counts of all nine states, which sum to the total."""
    return field_states(t).groupBy("p_brand").agg(*[F.count_if(F.col("state") == s).cast("long").alias(s) for s in STATES], F.count("*").alias("total"))


@query(f"""
WITH f AS (SELECT p_partkey, p_brand, state FROM (SELECT *, {STATE} AS state FROM part) WHERE state IN ('source_null', 'ambiguous', 'rejected') AND contains(lower(p_name), 'o'))
SELECT p_partkey, p_brand, state, (SELECT count(*) FROM f) AS total FROM f ORDER BY p_partkey LIMIT 50 OFFSET 10""")
def exceptions_page(t) -> DataFrame:
    """Exceptions of some states whose name holds a text, fifty a page."""
    return pages.entity_page(field_states(t), equal={"state": ["source_null", "ambiguous", "rejected"], "domain": None}, text="O", text_columns=("p_name",), sort="p_partkey", key="p_partkey", limit=50, offset=10).select("p_partkey", "p_brand", "state", "total")


@query(f"SELECT state, count(*) AS n FROM (SELECT {STATE} AS state FROM part) GROUP BY 1")
def quality_router(t) -> DataFrame:
    """A read is routed by its name; the overview is open from rank 1 on."""
    reads = serve.Reads()
    reads.add("overview", 1, lambda: field_states(t).groupBy("state").agg(F.count("*").alias("n")))
    reads.add("exceptions", 3, lambda: exceptions_page(t))
    return reads("overview", 1)


@query("""
SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 5000 THEN 1 WHEN s_acctbal > 0 THEN 2 ELSE 3 END AS trust_rank FROM supplier ORDER BY 3, 2 LIMIT 30""")
def trusted_sources(t) -> DataFrame:
    rank = F.when(F.col("s_acctbal") > 5000, 1).when(F.col("s_acctbal") > 0, 2).otherwise(3)
    return filters.page(t("supplier").select("s_suppkey", "s_name", rank.alias("trust_rank")), [F.col("trust_rank"), F.col("s_name")], 30)


@query(f"""
WITH {ENTITIES}, f AS (SELECT *, CASE WHEN score % 3 = 0 THEN 'internal' ELSE 'published' END AS publication FROM e), p AS (SELECT * FROM f WHERE publication = 'published' AND provider LIKE 'Brand%')
SELECT id, title, level, concat(title, ' by ', provider) AS summary, (SELECT count(*) FROM p) AS total FROM p ORDER BY title, id LIMIT 50""")
def public_contract(t) -> DataFrame:
    """What the public sees: published rows only, at most 50 of them, in the contract's fields."""
    rows = entities(t).withColumn("publication", F.when(F.col("score") % 3 == 0, "internal").otherwise("published")).where(F.col("provider").startswith("Brand"))
    found = pages.entity_page(rows, equal={"publication": "published"}, sort="title", key="id", limit=900, most=50)
    return found.select("id", "title", "level", F.concat("title", F.lit(" by "), "provider").alias("summary"), "total")


METRICS = {
    "lines": "true", "returned": "l_returnflag = 'R'", "accepted": "l_returnflag = 'A'", "neither": "l_returnflag = 'N'", "open_lines": "l_linestatus = 'O'", "closed_lines": "l_linestatus = 'F'", "discounted": "l_discount > 0",
    "large_discount": "l_discount > 0.05", "taxed": "l_tax > 0", "small": "l_quantity < 10", "large": "l_quantity > 40", "dear": "l_extendedprice > 30000", "cheap": "l_extendedprice < 5000", "late": "l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'",
}


@query("""
SELECT o_orderpriority, """ + ", ".join(f"count(*) FILTER (WHERE {c.replace('TIMESTAMP_NTZ', 'TIMESTAMP')}) AS {n}" for n, c in METRICS.items()) + """, count(DISTINCT l_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, count(DISTINCT c_nationkey) AS nations
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def completeness_bundle(t) -> DataFrame:
    """Seventeen metrics from one join: lines are summed by order before distinct keys are counted."""
    lines = t("lineitem").groupBy("l_orderkey").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in METRICS.items()])
    rows = lines.join(t("orders").select("o_orderkey", "o_orderpriority", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    by_customer = rows.groupBy("o_orderpriority", "o_custkey", "c_nationkey").agg(*[F.sum(n).alias(n) for n in METRICS], F.count("*").alias("orders"))
    by_nation = by_customer.groupBy("o_orderpriority", "c_nationkey").agg(*[F.sum(n).alias(n) for n in (*METRICS, "orders")], F.count("*").alias("customers"))
    return by_nation.groupBy("o_orderpriority").agg(*[F.sum(n).cast("long").alias(n) for n in (*METRICS, "orders", "customers")], F.count("*").alias("nations"))


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_size > 5) AS total, least(175, (SELECT count(*) FROM part WHERE p_size > 5)) AS next_offset, 175 < (SELECT count(*) FROM part WHERE p_size > 5) AS has_more FROM part WHERE p_size > 5 ORDER BY p_partkey LIMIT 75 OFFSET 100")
def batch_protocol(t) -> DataFrame:
    """A bounded batch with where to go on and whether there is more."""
    active = t("part").where("p_size > 5")
    total = active.count()
    state = pages.progress(total, 100, 75, 75)
    return filters.page(active, [F.col("p_partkey")], 75, 100).select("p_partkey", "p_name", F.lit(total).cast("long").alias("total"), F.lit(state["next_offset"]).cast("long").alias("next_offset"), F.lit(state["has_more"]).alias("has_more"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS r FROM customer) WHERE r = 1")
def latest_by_layer(t) -> DataFrame:
    return reconcile.first_by(t("customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", F.desc_nulls_last("c_acctbal"), F.col("c_custkey"))
