"""Filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import exprs
from gleanery.operators import filters, reconcile, serve

from .registry import query

def nulled(c: str, key: str, n: int):
    return F.when(F.col(key) % n != 0, F.col(c))


def n_of(condition, name: str):
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("long").alias(name)


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag, c_name, n_name, r_name, p_name, l_shipdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN part ON p_partkey = CASE WHEN l_partkey % 7 <> 0 THEN l_partkey END
WHERE l_returnflag = 'R' AND r_name = 'ASIA' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 1000""")
def star_join_observations(t) -> DataFrame:
    places = t("nation").join(filters.where(t("region"), r_name="ASIA"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")
    orders = t("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name", "r_name")
    lines = filters.where(t("lineitem"), l_returnflag="R", l_linestatus=None).select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", nulled("l_partkey", "l_partkey", 7).alias("part"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # The page comes before the lookup that only adds a column.
    top = filters.page(rows, [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], filters.clamp(1000, 1000, 1, 5000))
    return top.join(t("part").select("p_partkey", "p_name"), F.col("part") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "l_returnflag", "c_name", "n_name", "r_name", "p_name", "l_shipdate")


@query("""
SELECT o_orderkey, c_name, n_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE (NULL IS NULL OR o_orderstatus = NULL) AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND c_mktsegment = 'BUILDING'""")
def optional_filters(t) -> DataFrame:
    orders = filters.where(t("orders"), o_orderstatus=None, o_orderpriority=["1-URGENT", "2-HIGH"])
    buyers = filters.where(t("customer"), c_mktsegment="BUILDING").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name", "o_orderpriority")


@query("SELECT p_partkey, coalesce(upper(nullif(trim(concat(' ', CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE '' END, ' ')), '')), p_name) AS code FROM part")
def clean_text_nulls(t) -> DataFrame:
    padded = F.concat(F.lit(" "), F.coalesce(nulled("p_brand", "p_partkey", 5), F.lit("")), F.lit(" "))
    return t("part").select("p_partkey", F.coalesce(F.upper(exprs.clean(padded)), "p_name").alias("code"))


@query("SELECT s_suppkey, n_nationkey, n_name FROM supplier JOIN nation ON upper(trim(concat('  nation_', s_nationkey, ' '))) = upper(trim(concat('NATION_', n_nationkey)))")
def case_insensitive_join(t) -> DataFrame:
    left = t("supplier").select("s_suppkey", F.upper(F.trim(F.concat(F.lit("  nation_"), F.col("s_nationkey").cast("string"), F.lit(" ")))).alias("k"))
    right = t("nation").select("n_nationkey", "n_name", F.upper(F.trim(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")))).alias("k"))
    return left.join(right, "k").select("s_suppkey", "n_nationkey", "n_name")


@query("""
SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS has_return,
  EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45) AS has_large,
  EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1998-01-01') AS has_recent FROM part""")
def exists_flags(t) -> DataFrame:
    flags = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_quantity") >= 45).alias("q"), F.bool_or(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("d"))
    return t("part").select("p_partkey").join(flags, "p_partkey", "left").select("p_partkey", *[F.coalesce(a, F.lit(False)).alias(b) for a, b in (("r", "has_return"), ("q", "has_large"), ("d", "has_recent"))])


@query("""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
  OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9000)""")
def disjunctive_semi(t) -> DataFrame:
    own = t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    near = t("customer").join(t("supplier").where("s_acctbal > 9000"), F.col("s_nationkey") == F.col("c_nationkey"), "left_semi")
    return own.select("c_custkey").union(near.select("c_custkey")).distinct()


@query("""
SELECT o_orderkey, coalesce(string_agg(DISTINCT p_brand, '|' ORDER BY p_brand), '') AS brands, coalesce(string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag), '') AS flags
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""")
def lateral_agg(t) -> DataFrame:
    joined = t("lineitem").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    arrays = joined.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(text("p_brand").alias("brands"), text("l_returnflag").alias("flags"))
    return t("orders").select("o_orderkey").join(arrays, "o_orderkey", "left").select("o_orderkey", F.coalesce("brands", F.lit("")).alias("brands"), F.coalesce("flags", F.lit("")).alias("flags"))


@query("SELECT n_nationkey, coalesce(string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) FILTER (WHERE c_acctbal > 5000), '') AS segments FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def ordered_distinct_arrays(t) -> DataFrame:
    segments = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_set(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")))).alias("a"))
    return t("nation").select("n_nationkey").join(segments, "n_nationkey", "left").select("n_nationkey", F.coalesce(F.array_join("a", "|"), F.lit("")).alias("segments"))


@query("""
SELECT c_custkey, o_orderkey, price FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY price DESC NULLS LAST, o_orderkey) AS r
  FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price FROM orders)) ON o_custkey = c_custkey AND r = 1""")
def lateral_top1(t) -> DataFrame:
    orders = t("orders").select("o_custkey", "o_orderkey", nulled("o_totalprice", "o_orderkey", 11).alias("price"))
    best = reconcile.first_by(orders, "o_custkey", F.desc_nulls_last("price"), F.col("o_orderkey"))
    return t("customer").select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "price")


FEES = (("tuition", 3, "AUD {}"), ("other", 4, "{}"), ("total", 0, "${}"))


@query("""
WITH f AS (SELECT o_orderkey, unnest(['tuition', 'other', 'total']) AS fee_type, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE concat('AUD ', o_totalprice::DECIMAL(18,2)) END,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat((o_orderkey % 1000)::VARCHAR, '.50') END, concat('$', o_orderkey)]) AS raw FROM orders)
SELECT o_orderkey, fee_type, TRY_CAST(nullif(regexp_replace(raw, '[^0-9.-]', '', 'g'), '') AS DECIMAL(18,2)) AS amount, concat_ws(':', 'order', o_orderkey, fee_type) AS source_fee_key FROM f WHERE raw IS NOT NULL""")
def fee_unpivot(t) -> DataFrame:
    key = F.col("o_orderkey")
    a = F.when(key % 3 == 0, "n/a").otherwise(F.concat(F.lit("AUD "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    b = F.when(key % 4 != 0, F.concat((key % 1000).cast("string"), F.lit(".50")))
    wide = t("orders").select("o_orderkey", a.alias("tuition"), b.alias("other"), F.concat(F.lit("$"), key.cast("string")).alias("total"))
    long = wide.unpivot("o_orderkey", ["tuition", "other", "total"], "fee_type", "raw").where("raw is not null")
    return long.select("o_orderkey", "fee_type", exprs.amount(F.col("raw")).alias("amount"), F.concat_ws(":", F.lit("order"), key.cast("string"), F.col("fee_type")).alias("source_fee_key"))


@query("""
WITH codes AS (SELECT DISTINCT p_brand AS code FROM part), parents AS (SELECT DISTINCT substr(p_brand, 1, 7) AS parent FROM part WHERE p_size > 10)
SELECT code, parent FROM codes LEFT JOIN parents ON parent = substr(code, 1, 7)""")
def parent_lookup(t) -> DataFrame:
    codes = t("part").select(F.col("p_brand").alias("code")).distinct().withColumn("k", F.substring("code", 1, 7))
    parents = t("part").where("p_size > 10").select(F.substring("p_brand", 1, 7).alias("parent")).distinct()
    return codes.join(parents, F.col("k") == F.col("parent"), "left").select("code", "parent")


@query("""
WITH e AS (SELECT 'customer' AS entity_type, c_custkey AS entity_id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part),
p AS (SELECT * FROM e ORDER BY entity_id DESC, entity_type LIMIT 200)
SELECT entity_type, entity_id, coalesce(c_name, s_name, p_name) AS label FROM p LEFT JOIN customer ON entity_type = 'customer' AND c_custkey = entity_id
LEFT JOIN supplier ON entity_type = 'supplier' AND s_suppkey = entity_id LEFT JOIN part ON entity_type = 'part' AND p_partkey = entity_id""")
def polymorphic_join(t) -> DataFrame:
    kinds = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}
    edges = reduce(DataFrame.unionByName, [t(k).select(F.lit(k).alias("entity_type"), F.col(i).alias("entity_id")) for k, (i, _) in kinds.items()])
    labels = reduce(DataFrame.unionByName, [t(k).select(F.lit(k).alias("entity_type"), F.col(i).alias("entity_id"), F.col(n).alias("label")) for k, (i, n) in kinds.items()])
    return filters.page(edges, [F.desc("entity_id"), F.col("entity_type")], 200).join(labels, ["entity_type", "entity_id"], "left")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount = 0) AS undiscounted, count(*) FILTER (WHERE l_quantity > 40 AND l_tax > 0.05) AS large_taxed FROM lineitem")
def coverage_counts(t) -> DataFrame:
    return t("lineitem").agg(F.count("*").alias("n"), n_of(F.col("l_returnflag") == "R", "returned"), n_of(F.col("l_discount") == 0, "undiscounted"), n_of((F.col("l_quantity") > 40) & (F.col("l_tax") > 0.05), "large_taxed"))


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def distinct_counts(t) -> DataFrame:
    buyers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = t("orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "n_name")
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    # Distinct keys are made before they are counted; no row is expanded for each count.
    kept = orders.join(lines.select("o_orderkey").distinct(), "o_orderkey", "left_semi").distinct()
    by_customer = kept.groupBy("n_name", "c_custkey").agg(F.count("*").alias("orders")).groupBy("n_name").agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"))
    parts = lines.join(orders, "o_orderkey").select("n_name", "l_partkey").distinct().groupBy("n_name").agg(F.count("*").alias("parts"))
    return by_customer.join(parts, "n_name")


@query("""
SELECT r_name, coalesce(bool_or(c_mktsegment = 'BUILDING' AND c_acctbal > 0), false) AS building, coalesce(bool_or(c_mktsegment = 'NONE'), false) AS nothing
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def gate_pivot(t) -> DataFrame:
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    gate = lambda c, n: F.coalesce(F.bool_or(c), F.lit(False)).alias(n)
    return rows.groupBy("r_name").agg(gate((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0), "building"), gate(F.col("c_mktsegment") == "NONE", "nothing"))


@query("SELECT o_orderstatus, string_agg(concat(o_orderpriority, '=', n), ',' ORDER BY o_orderpriority) AS counts FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def object_agg(t) -> DataFrame:
    counts = t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    m = counts.groupBy("o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return m.select("o_orderstatus", F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at("m", k).cast("string"))), ",").alias("counts"))


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors")
def dashboard_counts(t) -> DataFrame:
    rows = [
        t("customer").agg(F.count("*").alias("customers")),
        t("orders").agg(F.count("*").alias("orders"), n_of(F.col("o_orderstatus") == "O", "open_orders")),
        t("part").agg(F.count("*").alias("parts")),
        t("events").agg(n_of(F.col("event_type") == "error", "errors")),
    ]
    return reduce(DataFrame.crossJoin, rows)  # one row each


@query("SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(t) -> DataFrame:
    return t("lineitem").groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT upper(trim(p_name)) AS code, count(DISTINCT p_brand) AS titles, min(p_brand) AS first_title FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def key_conflicts(t) -> DataFrame:
    pairs = t("part").select(F.upper(F.trim("p_name")).alias("code"), "p_brand").distinct()
    return pairs.groupBy("code").agg(F.count("p_brand").alias("titles"), F.min("p_brand").alias("first_title")).where("titles > 1")


@query("SELECT 'segment' AS facet, c_mktsegment AS code, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'brand', p_brand, count(*) FROM part GROUP BY ALL UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY ALL")
def facet_options(t) -> DataFrame:
    return serve.facets({"segment": (t("customer"), "c_mktsegment"), "brand": (t("part"), "p_brand"), "status": (t("orders"), "o_orderstatus")})


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, verified DESC NULLS LAST, o_orderkey) AS r
  FROM (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS verified FROM orders)) WHERE r = 1""")
def top1_identifier(t) -> DataFrame:
    orders = t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("is_primary"), nulled("o_orderdate", "o_orderkey", 3).alias("verified"))
    return reconcile.first_by(orders, "o_custkey", F.desc("is_primary"), F.desc_nulls_last("verified"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 2000)")
def global_rank(t) -> DataFrame:
    top = filters.page(t("part"), [F.desc("p_retailprice"), F.col("p_partkey")], 2000)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long").alias("place"))


@query("""
WITH a AS ((SELECT 'event' AS feed, event_id AS id, ts AS happened_at FROM events ORDER BY ts DESC, event_id LIMIT 10) UNION ALL (SELECT 'order', o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)
  UNION ALL (SELECT 'line', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber LIMIT 10))
SELECT * FROM a ORDER BY happened_at DESC, feed, id LIMIT 10""")
def recent_activity(t) -> DataFrame:
    feeds = (("event", t("events"), F.col("event_id"), "ts"), ("order", t("orders"), F.col("o_orderkey"), "o_orderdate"), ("line", t("lineitem"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_shipdate"))
    parts = [filters.page(df.select(F.lit(feed).alias("feed"), i.alias("id"), F.col(at).alias("happened_at")), [F.desc("happened_at"), F.col("id")], 10) for feed, df, i, at in feeds]
    return filters.page(reduce(DataFrame.unionByName, parts), [F.desc("happened_at"), F.col("feed"), F.col("id")], 10)


@query("SELECT doc_id, source, n_chars, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def paged_search(t) -> DataFrame:
    rows = filters.where(t("documents").select("doc_id", "source", "n_chars", "lang"), lang="en")
    return filters.page(rows, [F.desc("n_chars"), F.col("doc_id")], filters.clamp(20, 20, 1, 50), 40).select("doc_id", "source", "n_chars").crossJoin(rows.agg(F.count("*").alias("total")))


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 5 ORDER BY p_partkey LIMIT 50 OFFSET 100")
def bounded_slice(t) -> DataFrame:
    return filters.page(t("part").where("p_size > 5"), [F.col("p_partkey")], 50, 100).select("p_partkey", "p_name")


@query("""
SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS a, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 90 DAY END AS b FROM orders)
WHERE (a IS NULL OR a <= TIMESTAMP '1996-06-30') AND (b IS NULL OR b >= TIMESTAMP '1996-06-30')""")
def validity_window(t) -> DataFrame:
    end = F.col("o_orderdate") + F.expr("interval 90 days")
    rows = t("orders").select("o_orderkey", nulled("o_orderdate", "o_orderkey", 5).alias("a"), F.when(F.col("o_orderkey") % 7 != 0, end).alias("b"))
    return rows.where(filters.valid_at(F.col("a"), F.col("b"), F.lit("1996-06-30").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT l_orderkey FROM (SELECT l_orderkey, list(CASE WHEN l_linenumber <> 2 THEN l_returnflag END) AS a FROM lineitem GROUP BY 1) WHERE list_contains(a, 'R')")
def array_overlap_filter(t) -> DataFrame:
    arrays = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.collect_list(F.struct(F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("f"))), lambda x: x["f"]).alias("a"))
    return arrays.where(filters.overlaps(F.col("a"), F.array(F.lit("R"), F.lit("Z")))).select("l_orderkey")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) - INTERVAL 24 HOUR FROM events) GROUP BY 1")
def last_24h_counts(t) -> DataFrame:
    last = t("events").agg((F.max("ts") - F.expr("interval 24 hours")).alias("since"))
    return t("events").crossJoin(F.broadcast(last)).where("ts > since").groupBy("event_type").agg(F.count("*").alias("n"))  # one row


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DECIMAL(18,2) AS quantity, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DECIMAL(28,4) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(t) -> DataFrame:
    rows = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    revenue = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("decimal(18,2)").alias("quantity"), F.sum(revenue).cast("decimal(28,4)").alias("revenue"), F.count("*").alias("n"))
