"""Cleaning, lookups and governed applies over the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import exprs
from gleanery.operators import apply, gates, pages, snapshot
from gleanery.session import scratch
from gleanery.sources import generations

from .registry import query

text = lambda c: F.col(c).cast("string")
date = lambda d: F.lit(d).cast("date")


@query("""
WITH r AS (SELECT o_orderstatus, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 1000)::VARCHAR || '.25' WHEN 1 THEN 'n/a' WHEN 2 THEN '12.' END AS raw FROM orders),
p AS (SELECT *, CASE WHEN regexp_full_match(raw, '[0-9]+([.][0-9]+)?') THEN raw::DECIMAL(18,2) END AS v FROM r)
SELECT o_orderstatus, count(v) AS valid, count(*) FILTER (WHERE raw IS NOT NULL AND v IS NULL) AS invalid, count(*) FILTER (WHERE raw IS NULL) AS absent, sum(v)::DECIMAL(28,2) AS total FROM p GROUP BY 1""")
def guarded_numbers(t) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat((k % 1000).cast("string"), F.lit(".25"))).when(k % 4 == 1, "n/a").when(k % 4 == 2, "12.")
    rows = t("orders").select("o_orderstatus", raw.alias("raw")).withColumn("v", exprs.plain_number(F.col("raw")))
    return rows.groupBy("o_orderstatus").agg(F.count("v").alias("valid"), F.count_if(F.col("raw").isNotNull() & F.col("v").isNull()).alias("invalid"), F.count_if(F.col("raw").isNull()).alias("absent"), F.sum("v").cast("decimal(28,2)").alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), '1 b')")
def substring_search(t) -> DataFrame:
    return t("customer").where(pages.contains_text("1 B", "c_name", "c_mktsegment")).select("c_custkey", "c_name")


@query(r"SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE 'NATION\_1%' ESCAPE '\'")
def like_escape(t) -> DataFrame:
    return t("nation").where(F.expr(r"n_name like 'NATION!_1%' escape '!'")).select("n_nationkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END, 'active') NOT IN ('F', 'P')")
def not_in_default(t) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus"))
    return t("orders").where(~F.coalesce(status, F.lit("active")).isin("F", "P")).select("o_orderkey")


@query("""
SELECT o_orderkey, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(concat(' B,a , ,', o_orderstatus, ',', lower(o_orderpriority)), ','), lambda x: lower(trim(x))), lambda x: x <> ''))), '|'), '') AS codes FROM orders""")
def parameter_array(t) -> DataFrame:
    raw = F.split(F.concat(F.lit(" B,a , ,"), "o_orderstatus", F.lit(","), F.lower("o_orderpriority")), ",")
    return t("orders").select("o_orderkey", F.array_join(exprs.cleaned_codes(raw), "|").alias("codes"))


@query("""
SELECT o_orderkey, len(a)::BIGINT AS total, array_to_string(a[2:3], '|') AS items FROM (SELECT l_orderkey AS o_orderkey, list(concat(l_linenumber, ':', l_partkey) ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1)""")
def list_slice(t) -> DataFrame:
    item = lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))
    lists = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    return lists.select("o_orderkey", F.size("a").cast("long").alias("total"), F.array_join(F.transform(F.slice("a", 2, 2), item), "|").alias("items"))


@query("""
WITH n AS (SELECT s_suppkey, concat('The ', s_name, CASE s_suppkey % 3 WHEN 0 THEN ' Pty Ltd' WHEN 1 THEN ' (Campus) Australia' ELSE ' Limited' END) AS x FROM supplier),
f AS (SELECT s_suppkey, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(x), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS b FROM n),
g AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(b, '^the ', ''), ' (pty ltd|pty limited|limited|ltd|inc)$', ''), ' australia$', '')) AS c FROM f)
SELECT s_suppkey, array_to_string(list_sort(list_distinct([a, b, c])), '|') AS forms FROM g""".replace("\\\\", "\\"))
def legal_alias_forms(t) -> DataFrame:
    k = F.col("s_suppkey") % 3
    name = F.concat(F.lit("The "), "s_name", F.when(k == 0, " Pty Ltd").when(k == 1, " (Campus) Australia").otherwise(" Limited"))
    return t("supplier").select("s_suppkey", F.array_join(exprs.alias_forms(name), "|").alias("forms"))


@query("""
SELECT c_custkey, concat(upper(c_mktsegment[1]), lower(c_mktsegment[2:])) AS title, strpos(c_name, '#')::BIGINT AS place, left(c_name, 4) AS start, format('{}/{}', c_custkey, c_nationkey) AS code, substr(c_name, 3, 5) AS part, replace(c_name, '#', '-') AS dashed FROM customer""")
def string_functions(t) -> DataFrame:
    return t("customer").select("c_custkey", F.initcap("c_mktsegment").alias("title"), F.instr("c_name", "#").cast("long").alias("place"), F.left("c_name", F.lit(4)).alias("start"), F.format_string("%d/%d", "c_custkey", "c_nationkey").alias("code"), F.substring("c_name", 3, 5).alias("part"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("dashed"))


@query("""
SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') AS stamp, ts::DATE AS day, epoch(date_trunc('second', ts))::BIGINT AS seconds, date_diff('day', TIMESTAMP '2024-01-01', ts)::BIGINT AS days FROM events""")
def date_functions(t) -> DataFrame:
    ts = F.col("ts")
    day = ts.cast("date")
    return t("events").select("event_id", F.date_format(ts, "yyyyMMdd'T'HHmmss").alias("stamp"), day.alias("day"), F.unix_timestamp(ts.cast("timestamp")).alias("seconds"), F.date_diff(day, date("2024-01-01")).cast("long").alias("days"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderdate::DATE END AS opens, CASE WHEN month(o_orderdate) >= 6 THEN 2026 ELSE 2027 END::BIGINT AS next_year FROM orders""")
def date_parse(t) -> DataFrame:
    """Dates such as "12 August 2026", and the year in which a month comes next, seen from June 2026."""
    written = F.when(F.col("o_orderkey") % 3 == 0, "to be advised").otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    rows = t("orders").select("o_orderkey", written.alias("x"), F.date_format("o_orderdate", "MMMM").alias("month"))
    return rows.select("o_orderkey", exprs.written_date(F.col("x")).alias("opens"), exprs.next_year(F.col("month"), date("2026-06-15")).cast("long").alias("next_year"))


@query("""
WITH n AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'Doctor of ' WHEN 1 THEN 'Master of ' WHEN 2 THEN 'Graduate Diploma in ' WHEN 3 THEN 'Bachelor of ' WHEN 4 THEN 'Advanced Diploma of ' WHEN 5 THEN 'Certificate in ' ELSE 'Short course: ' END AS x, p_size FROM part)
SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'doctorate' WHEN 1 THEN 'master' WHEN 2 THEN 'graduate' WHEN 3 THEN 'bachelor' WHEN 4 THEN 'advanced_diploma' WHEN 5 THEN 'certificate' ELSE 'other' END AS level, lpad(p_size::VARCHAR, 4, '0') AS field_code, 'Field of ' || p_size AS field_name FROM n""")
def title_classes(t) -> DataFrame:
    s = F.col("p_size") % 7
    start = reduce(lambda c, x: c.when(s == x[0], x[1]), enumerate(("Master of ", "Graduate Diploma in ", "Bachelor of ", "Advanced Diploma of ", "Certificate in "), 1), F.when(s == 0, "Doctor of ")).otherwise("Short course: ")
    field = F.concat(F.lpad(text("p_size"), 4, "0"), F.lit(" - Field of "), text("p_size"))
    code, name = exprs.code_and_name(F.col("field"))
    return t("part").select("p_partkey", F.concat(start, "p_name").alias("title"), field.alias("field")).select("p_partkey", exprs.study_level(F.col("title")).alias("level"), code.alias("field_code"), name.alias("field_name"))


@query("""
SELECT o_orderkey, len(a)::BIGINT AS n, array_to_string(list_append(a, 99), ',') AS more, list_contains(a, 1) AS has_one, array_to_string(list_intersect([3, 1], a), ',') <> '' AS meets FROM (SELECT l_orderkey AS o_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem WHERE l_quantity > 10 GROUP BY 1)""")
def array_functions(t) -> DataFrame:
    a = t("lineitem").where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    return a.select("o_orderkey", F.size("a").cast("long").alias("n"), F.array_join(F.transform(F.array_append("a", 99), lambda x: x.cast("string")), ",").alias("more"), F.array_contains("a", 1).alias("has_one"), F.arrays_overlap("a", F.array(F.lit(3), F.lit(1))).alias("meets"))


@query("""
SELECT event_id, concat('{"k":"', props->>'$.k', '","kind":"', event_type, '","state":"set"}') AS edited, 1::BIGINT AS n_keys, 'number' AS kind FROM events""")
def json_edit(t) -> DataFrame:
    """Set a key, merge an object, remove a key and strip nulls; keys in order."""
    m = exprs.json_map(F.col("props"))
    none = F.lit(None).cast("string")
    merged = exprs.map_merged(m, F.create_map(F.lit("kind"), F.col("event_type"), F.lit("gone"), F.lit("x"), F.lit("empty"), none))
    edited = exprs.map_set(exprs.map_without(merged, "gone"), "state", F.lit("set"))
    kind = F.when(F.regexp_like(F.element_at(m, "k"), F.lit("^-?[0-9.]+$")), "number").otherwise("string")
    return t("events").select("event_id", exprs.map_json(edited).alias("edited"), F.size(m).cast("long").alias("n_keys"), kind.alias("kind"))


@query("""
SELECT user_id, string_agg(concat(event_id, ':', event_type), ',' ORDER BY event_id) AS safe FROM events GROUP BY 1""")
def json_redact_array(t) -> DataFrame:
    """Objects of an array reduced to the allowed keys, in the array's order."""
    full = F.struct("event_id", "event_type", F.lit("s3cret").alias("token"))
    docs = t("events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(full))).alias("doc"))
    kept = F.from_json("doc", "array<struct<event_id:bigint,event_type:string>>")
    return docs.select("user_id", F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["event_id"].cast("string"), x["event_type"])), ",").alias("safe"))


@query("""
SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS kinds, count(*) AS n FROM events GROUP BY 1""")
def json_strings(t) -> DataFrame:
    """A JSON array of strings read back as an array."""
    docs = t("events").groupBy("user_id").agg(F.to_json(F.collect_list("event_type")).alias("doc"))
    a = F.from_json("doc", "array<string>")
    return docs.select("user_id", F.array_join(F.array_sort(F.array_distinct(a)), "|").alias("kinds"), F.size(a).cast("long").alias("n"))


@query("""
SELECT o_custkey, greatest(coalesce(max(o_orderdate), TIMESTAMP '1970-01-01'), coalesce(max(CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 30 DAY END), TIMESTAMP '1970-01-01')) AS changed_at FROM orders GROUP BY 1""")
def greatest_with_defaults(t) -> DataFrame:
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    late = F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate") + F.expr("interval 30 days")))
    return t("orders").groupBy("o_custkey").agg(F.greatest(F.coalesce(F.max("o_orderdate"), start), F.coalesce(late, start)).alias("changed_at"))


# Lookups in steps.

PROVIDERS = "p AS (SELECT s_suppkey AS provider_id, upper(s_name) AS provider_code FROM supplier WHERE s_acctbal > -900), c AS (SELECT DISTINCT l_suppkey AS provider_id, concat('P', l_partkey) AS course_code, md5(concat(l_suppkey, ':', l_partkey)) AS course_id FROM lineitem WHERE l_returnflag <> 'N')"
RECORDS = "r AS (SELECT l_orderkey, l_linenumber, upper(s_name) AS provider_code, concat('P', l_partkey) AS course_code FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'O')"


def catalogue(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    providers = t("supplier").where("s_acctbal > -900").select(F.col("s_suppkey").alias("provider_id"), F.upper("s_name").alias("provider_code"))
    courses = t("lineitem").where("l_returnflag <> 'N'").select(F.col("l_suppkey").alias("provider_id"), F.concat(F.lit("P"), text("l_partkey")).alias("course_code")).distinct()
    courses = courses.withColumn("course_id", F.md5(F.concat_ws(":", text("provider_id"), F.substring("course_code", 2, 20))))
    names = t("supplier").select("s_suppkey", F.upper("s_name").alias("provider_code"))
    records = t("lineitem").where("l_linestatus = 'O'").join(names, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "provider_code", F.concat(F.lit("P"), text("l_partkey")).alias("course_code"))
    return providers, courses, records


@query(f"""
WITH {PROVIDERS}, {RECORDS} SELECT l_orderkey, l_linenumber, p.provider_id, course_id, CASE WHEN p.provider_id IS NULL THEN 'provider_missing' WHEN course_id IS NULL THEN 'course_missing' ELSE 'resolved' END AS state
FROM r LEFT JOIN p USING (provider_code) LEFT JOIN c ON c.provider_id = p.provider_id AND c.course_code = r.course_code""")
def compound_resolution(t) -> DataFrame:
    providers, courses, records = catalogue(t)
    return apply.by_provider(records, providers, courses).select("l_orderkey", "l_linenumber", "provider_id", "course_id", "state")


@query(f"""
WITH {PROVIDERS}, {RECORDS}, x AS (SELECT r.*, p.provider_id, c.course_id FROM r LEFT JOIN p USING (provider_code) LEFT JOIN c ON c.provider_id = p.provider_id AND c.course_code = r.course_code),
k AS (SELECT provider_code, course_code, any_value(provider_id) AS provider_id, any_value(course_id) AS course_id, count(*) AS n FROM x GROUP BY 1, 2)
SELECT coalesce(course_id, md5(concat('course:', lower(provider_code), ':', lower(course_code)))) AS course_id, coalesce(provider_id::VARCHAR, md5(concat('provider:', lower(provider_code)))) AS provider_id, provider_code, course_code,
  CASE WHEN course_id IS NOT NULL THEN 'existing' ELSE 'created' END AS outcome, n AS records FROM k""")
def course_reconciliation(t) -> DataFrame:
    """Both steps and what they write: ids found or made, one row for each course of a provider."""
    providers, courses, records = catalogue(t)
    keys = records.groupBy("provider_code", "course_code").agg(F.count("*").alias("records"))
    found = apply.by_provider(keys, providers, courses)
    made = F.md5(F.concat_ws(":", F.lit("course"), F.lower("provider_code"), F.lower("course_code")))
    owner = F.coalesce(text("provider_id"), F.md5(F.concat(F.lit("provider:"), F.lower("provider_code"))))
    return found.select(F.coalesce("course_id", made).alias("course_id"), owner.alias("provider_id"), "provider_code", "course_code", F.when(F.col("course_id").isNotNull(), "existing").otherwise("created").alias("outcome"), "records")


@query("SELECT DISTINCT c_nationkey AS missing FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def required_lookup(t) -> DataFrame:
    known = t("nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return apply.required(t("customer").select("c_nationkey"), "c_nationkey", known)[1].withColumnRenamed("c_nationkey", "missing")


@query("""
WITH l AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier), d AS (SELECT concat('/p/', s_suppkey) AS url, s_suppkey, concat('Code: S', s_suppkey + (CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END)) AS body FROM supplier WHERE s_nationkey <> 3)
SELECT l.s_suppkey, l.s_name, body IS NOT NULL AS has_page, coalesce(body = concat('Code: S', l.s_suppkey), false) AS verified FROM l LEFT JOIN d ON d.url = concat('/p/', l.s_suppkey)""")
def list_and_detail(t) -> DataFrame:
    """A list joined to its detail pages, and whether the page shows the listed code."""
    s = t("supplier")
    details = s.where("s_nationkey <> 3").select(F.concat(F.lit("/p/"), text("s_suppkey")).alias("url"), F.concat(F.lit("Code: S"), (F.col("s_suppkey") + F.when(F.col("s_acctbal") < 0, 1).otherwise(0)).cast("string")).alias("body"))
    shown = F.regexp_extract("body", r"Code: (\w+)", 1) == F.concat(F.lit("S"), text("s_suppkey"))
    return s.withColumn("url", F.concat(F.lit("/p/"), text("s_suppkey"))).join(details, "url", "left").select("s_suppkey", "s_name", F.col("body").isNotNull().alias("has_page"), F.coalesce(shown, F.lit(False)).alias("verified"))


@query("""
SELECT 'nation' AS dimension, count(*) AS members, count(*) FILTER (WHERE n_name NOT LIKE '%0') AS active, string_agg(n_name, '|' ORDER BY n_name) FILTER (WHERE n_name NOT LIKE '%0') AS names FROM nation
UNION ALL SELECT 'region', count(*), count(*) FILTER (WHERE r_name <> 'ASIA'), string_agg(r_name, '|' ORDER BY r_name) FILTER (WHERE r_name <> 'ASIA') FROM region""")
def cube_metadata(t) -> DataFrame:
    """Dimensions of a cube with their members as nested JSON: active members, totals left out."""
    member = lambda n, total: F.struct(F.col(n).alias("name"), (~total).alias("leaf"))
    nation = t("nation").agg(F.lit("nation").alias("dimension"), F.collect_list(member("n_name", F.col("n_name").like("%0"))).alias("members"))
    region = t("region").agg(F.lit("region").alias("dimension"), F.collect_list(member("r_name", F.col("r_name") == "ASIA")).alias("members"))
    cube = nation.unionByName(region).select(F.to_json(F.struct("dimension", "members")).alias("doc"))  # a few members each
    read = cube.select(F.from_json("doc", "struct<dimension:string,members:array<struct<name:string,leaf:boolean>>>").alias("d")).select("d.dimension", F.explode("d.members").alias("m"))
    leaf = F.col("m.leaf")
    return read.groupBy("dimension").agg(F.count("*").alias("members"), F.count_if(leaf).alias("active"), F.array_join(F.array_sort(F.collect_list(F.when(leaf, F.col("m.name")))), "|").alias("names"))


# Validated applies.

FLOW = """
f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate, l_quantity, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS value, l_returnflag = 'A' OR l_linenumber = 7 AS suppressed, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus, l_extendedprice, o_custkey, o_orderdate, o_orderstatus, o_orderpriority, c_nationkey, p_size
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey)"""
#: Name and condition of each check, the same text for both engines.
CHECKS = {
    "order_known": "o_custkey IS NOT NULL",
    "customer_known": "c_nationkey IS NOT NULL",
    "part_known": "p_size IS NOT NULL",
    "flag_listed": "l_returnflag IN ('A', 'N', 'R')",
    "status_listed": "l_linestatus IN ('O', 'F')",
    "value_or_suppressed": "(value IS NULL) <> (NOT suppressed)",
    "value_positive": "value IS NULL OR value > 0",
    "value_whole": "value IS NULL OR value = floor(value)",
    "value_bound": "value IS NULL OR value <= 49",
    "price_positive": "l_extendedprice > 0",
    "discount_range": "l_discount BETWEEN 0 AND 0.09",
    "tax_range": "l_tax BETWEEN 0 AND 0.07",
    "line_range": "l_linenumber BETWEEN 1 AND 6",
    "ship_after_order": "l_shipdate >= o_orderdate",
    "size_range": "p_size BETWEEN 1 AND 45",
    "open_not_final": "NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')",
}


def flow(t) -> DataFrame:
    lines = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "*")
    rows = lines.join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"), "left").join(t("part").select("p_partkey", "p_size"), F.col("p_partkey") == F.col("l_partkey"), "left")
    hidden = F.col("l_returnflag") == "A"
    return rows.withColumns({"value": F.when(~hidden, F.col("l_quantity")), "suppressed": hidden | (F.col("l_linenumber") == 7)})


@query(f"WITH {FLOW} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, id FROM f WHERE NOT coalesce({c}, false)" for n, c in CHECKS.items()) + ")")
def flow_validation(t) -> DataFrame:
    """Sixteen checks of each row, in one scan."""
    return apply.checked(flow(t), {n: F.expr(c) for n, c in CHECKS.items()}).select(F.explode("errors").alias("rule"), "id")


OK = " AND ".join(f"coalesce({c}, false)" for c in CHECKS.values())


@query(f"""
WITH {FLOW}, g AS (SELECT f.*, {OK} AS ok, bool_and({OK}) OVER (PARTITION BY id // 10) AS whole FROM f)
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE whole) AS applied, sum(value) FILTER (WHERE whole)::DECIMAL(28,2) AS total FROM g GROUP BY 1""")
def flow_apply(t) -> DataFrame:
    """The lines of an order are a batch, which applies whole or not at all."""
    rows = apply.checked(flow(t), {n: F.expr(c) for n, c in CHECKS.items()})
    counts = rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.size("errors") == 0).alias("valid"))
    written = apply.accepted(rows, "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("applied"), F.sum("value").cast("decimal(28,2)").alias("total"))
    return counts.join(written, "l_returnflag", "left").select("l_returnflag", "n", "valid", F.coalesce("applied", F.lit(0)).cast("long").alias("applied"), "total")


@query("""
SELECT o_orderstatus, n_name, count(*) AS n, sum(l_quantity)::DECIMAL(28,2) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def gated_facts(t) -> DataFrame:
    """Facts that pass four gates: each line finds its order, customer and nation, each is sound,
    and rows and quantities are what the source states. Any failure stops the query as a whole."""
    stated = t("lineitem").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity")).first()  # the source's own totals, one row
    lines = gates.found(t("lineitem"), t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"), ["l_orderkey"], "order")
    lines = gates.found(lines, t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), ["o_custkey"], "customer")
    lines = gates.found(lines, t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), ["c_nationkey"], "nation")
    lines = gates.sound(apply.checked(lines, {n: F.expr(CHECKS[n]) for n in ("flag_listed", "status_listed", "price_positive")}), "l_orderkey")
    lines = gates.controlled(lines, {"rows": (F.count("*"), stated["rows"]), "quantity": (F.sum("l_quantity"), stated["quantity"])})
    return lines.groupBy("o_orderstatus", "n_name").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("decimal(28,2)").alias("total"))


@query("""
WITH n AS (SELECT s_suppkey, s_nationkey, s_acctbal AS v FROM supplier), ok AS (SELECT * FROM n WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4) AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AND v > -800),
o AS (SELECT s_suppkey, round(s_acctbal) AS v, DATE '2024-01-01' AS changed_at FROM supplier WHERE s_acctbal < 5000)
SELECT coalesce(ok.s_suppkey, o.s_suppkey) AS s_suppkey, CASE WHEN ok.s_suppkey IS NOT NULL THEN ok.v ELSE o.v END AS v, CASE WHEN ok.s_suppkey IS NOT NULL AND NOT (o.s_suppkey IS NOT NULL AND ok.v IS NOT DISTINCT FROM o.v) THEN DATE '2024-02-01' ELSE o.changed_at END AS changed_at
FROM o FULL JOIN ok ON o.s_suppkey = ok.s_suppkey""")
def outcome_upsert(t) -> DataFrame:
    """Outcomes whose provider's country, survey and mapping are known replace older ones where they differ."""
    s = t("supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("v"))
    known = s.join(t("nation").where("n_regionkey < 4"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").join(t("lineitem").where("l_returnflag = 'R'"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")
    old = t("supplier").where("s_acctbal < 5000").select("s_suppkey", F.round("s_acctbal").alias("v"), date("2024-01-01").alias("changed_at"))
    return snapshot.upsert(old, known.where("v > -800").select("s_suppkey", "v"), ["s_suppkey"], "changed_at", date("2024-02-01"))


@query("""
WITH o AS (SELECT s_suppkey, s_nationkey AS target, DATE '2024-01-01' AS verified_at FROM supplier WHERE s_acctbal > 0), n AS (SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_nationkey + 1 ELSE s_nationkey END AS target FROM supplier)
SELECT n.s_suppkey, n.target, CASE WHEN o.target IS NOT DISTINCT FROM n.target THEN o.verified_at ELSE DATE '2024-03-01' END AS verified_at FROM n LEFT JOIN o USING (s_suppkey)""")
def mapping_upsert(t) -> DataFrame:
    old = t("supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_nationkey").alias("target"), date("2024-01-01").alias("verified_at"))
    new = t("supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 5000, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")).alias("target"))
    return apply.mapping_upsert(old, new, ["s_suppkey"], date("2024-03-01"))


BATCH = """
cur AS (SELECT o_orderkey, o_orderstatus AS v, DATE '2024-01-01' AS at FROM orders WHERE o_totalprice < 200000), b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END AS v, DATE '2024-02-01' AS at FROM orders WHERE o_totalprice > 20000)"""


def batches(t) -> tuple[DataFrame, DataFrame]:
    o = t("orders")
    v = F.col("o_orderstatus")
    cur = o.where("o_totalprice < 200000").select("o_orderkey", v.alias("v"), date("2024-01-01").alias("at"), F.lit(None).cast("date").alias("valid_to"), F.lit("current").alias("status"))
    return cur, o.where("o_totalprice > 20000").select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(v).alias("v"), date("2024-02-01").alias("at"))


@query(f"""
WITH {BATCH} SELECT CASE WHEN cur.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN cur.v = b.v THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n FROM cur FULL JOIN b ON cur.o_orderkey = b.o_orderkey GROUP BY 1""")
def snapshot_plan(t) -> DataFrame:
    """The dry run of a snapshot apply."""
    return apply.snapshot_plan(*batches(t), "o_orderkey", ["v"])


@query(f"""
WITH {BATCH} SELECT cur.*, b.at AS valid_to, CASE WHEN b.o_orderkey IS NULL THEN 'current' ELSE 'superseded' END AS status FROM cur LEFT JOIN b USING (o_orderkey) UNION ALL SELECT *, NULL, 'current' FROM b""")
def snapshot_apply(t) -> DataFrame:
    """The same batch applied twice: the replay changes nothing."""
    cur, batch = batches(t)
    once = apply.snapshot_apply(cur, batch, "o_orderkey", "at")
    return apply.snapshot_apply(once, batch, "o_orderkey", "at")


@query("""
WITH o AS (SELECT doc_id, sha256(text) AS h, 11 AS g FROM documents WHERE n_chars < 6000), n AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN concat(text, '!') ELSE text END) AS h FROM documents WHERE n_chars > 100)
SELECT n.doc_id, n.h AS content_hash, CASE WHEN o.h = n.h THEN o.g ELSE 12 END AS generation FROM n LEFT JOIN o USING (doc_id)""")
def projection_sync(t) -> DataFrame:
    """Changed and new documents get the next generation, others keep theirs, vanished ones go."""
    d = t("documents")
    old = d.where("n_chars < 6000").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit(11).alias("generation"))
    new = d.where("n_chars > 100").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return apply.projection_sync(old, new, "doc_id", 12).select("doc_id", "content_hash", "generation")


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE n_chars < 6000), b AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN concat(text, '!') ELSE text END) AS h FROM documents WHERE n_chars > 100),
x AS (SELECT count(*) FILTER (WHERE a.h IS NULL) AS added, count(*) FILTER (WHERE a.h <> b.h) AS changed, count(*) FILTER (WHERE a.h = b.h) AS same, count(*) FILTER (WHERE b.h IS NULL) AS removed FROM a FULL JOIN b USING (doc_id)),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)
SELECT 1 AS generation, na AS new, 0 AS changed, 0 AS unchanged, 0 AS removed, na AS rows, na AS applied FROM n
UNION ALL SELECT 2, added, changed, same, removed, nb, added + changed FROM x, n
UNION ALL SELECT 3, 0, 0, nb, 0, nb, 0 FROM n""")
def projection_publish(t) -> DataFrame:
    """Two generations of a projection and a replay: what each sync counted and wrote."""
    d = t("documents")
    spark = d.sparkSession
    table = generations.Generations(spark, scratch(spark, "projection"), "doc_id")
    edited = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    first = d.where("n_chars < 6000").select("doc_id", F.sha2("text", 256).alias("content_hash"), "lang")
    second = d.where("n_chars > 100").select("doc_id", F.sha2(edited, 256).alias("content_hash"), "lang")
    done = [table.sync(rows) for rows in (first, second, second)]
    columns = ["generation", "new", "changed", "unchanged", "removed", "rows", "applied"]
    return spark.createDataFrame([tuple(x[c] for c in columns) for x in done], ", ".join(f"{c} long" for c in columns))  # a row for each sync


#: The child relations of a nested document: name, the lines that belong there.
PARTS = {"cycle": "l_linenumber = 1", "window": "l_returnflag = 'R'", "scope": "l_returnflag = 'A'", "group": "l_linestatus = 'F'", "criterion": "l_quantity > 40", "tier": "l_discount > 0.08", "coverage": "l_tax > 0.06"}


@query("WITH x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS relation, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE {c}" for n, c in PARTS.items()) + """),
y AS (SELECT relation, l_orderkey, row_number() OVER (PARTITION BY relation, l_orderkey ORDER BY l_linenumber, l_partkey) AS ord, l_partkey FROM x)
SELECT relation, l_orderkey, ord, l_partkey AS target, md5(concat('doc:', l_orderkey, ':', relation, ':', ord)) AS id, l_partkey <= (SELECT max(p_partkey) FROM part) AS target_known FROM y""")
def document_shred(t) -> DataFrame:
    """Nested documents into seven relations with ids that their places give; targets are looked up."""
    line = F.struct("l_linenumber", "l_partkey")
    docs = t("lineitem").groupBy("l_orderkey").agg(*[F.array_sort(F.collect_list(F.when(F.expr(c), line))).alias(n) for n, c in PARTS.items()])
    nested = docs.select("l_orderkey", F.explode(F.create_map(*[x for n in PARTS for x in (F.lit(n), F.col(n))])).alias("relation", "children"))
    rows = nested.select("l_orderkey", "relation", F.posexplode("children").alias("place", "x")).select("relation", "l_orderkey", (F.col("place") + 1).cast("long").alias("ord"), F.col("x.l_partkey").alias("target"))
    known = t("part").select(F.col("p_partkey").alias("target"), F.lit(True).alias("there"))
    return rows.join(known, "target", "left").select("relation", "l_orderkey", "ord", "target", F.md5(F.concat_ws(":", F.lit("doc"), text("l_orderkey"), "relation", text("ord"))).alias("id"), F.coalesce("there", F.lit(False)).alias("target_known"))


@query("""
WITH m AS (SELECT o_orderkey AS course, min(o_custkey) AS provider FROM orders GROUP BY 1), l AS (SELECT l_orderkey AS course, CASE WHEN l_linestatus = 'O' THEN l_suppkey END AS provider, concat('Campus ', l_linenumber) AS location FROM lineitem)
SELECT DISTINCT l.course, coalesce(l.provider, m.provider) AS provider, location FROM l LEFT JOIN m USING (course) WHERE coalesce(l.provider, m.provider) IS NOT NULL""")
def course_locations(t) -> DataFrame:
    """Locations of courses, one row for each key; a missing provider comes from the course."""
    lines = t("lineitem")
    parts = 16 * lines.rdd.getNumPartitions()  # grows with the table, so that a task's share doesn't
    owners = t("orders").select(F.col("o_orderkey").alias("course"), "o_custkey").repartition(parts, "course").groupBy("course").agg(F.min("o_custkey").alias("owner"))
    places = lines.select(F.col("l_orderkey").alias("course"), F.when(F.col("l_linestatus") == "O", F.col("l_suppkey")).alias("own"), "l_linenumber").repartition(parts, "course")
    rows = places.join(owners, "course", "left").select("course", F.coalesce("own", "owner").alias("provider"), "l_linenumber")
    # Numbers are compared instead of the names that are made from them.
    rows = rows.where("provider is not null").dropDuplicates(["course", "provider", "l_linenumber"])
    return rows.select("course", "provider", F.concat(F.lit("Campus "), text("l_linenumber")).alias("location"))


SEEDS = (("ASIA", "East"), ("NEWLAND", "Far"), ("EUROPE", "Old"))


@query("SELECT coalesce(r_name, code) AS code, coalesce(label, r_name) AS label FROM region FULL JOIN (VALUES ('ASIA', 'East'), ('NEWLAND', 'Far'), ('EUROPE', 'Old')) s(code, label) ON code = r_name")
def seeded_dimension(t) -> DataFrame:
    """Seeds upserted into a dimension, twice with the same result."""
    old = t("region").select(F.col("r_name").alias("code"), F.col("r_name").alias("label"))
    seeds = old.sparkSession.createDataFrame(SEEDS, "code string, label string")
    return snapshot.upsert(snapshot.upsert(old, seeds, ["code"]), seeds, ["code"])


@query("""
SELECT s_suppkey, CASE WHEN state = 'draft' AND s_acctbal > 0 THEN 'qualified' WHEN state = 'qualified' AND s_acctbal < -500 THEN 'deferred' ELSE state END AS state FROM (SELECT *, CASE WHEN s_nationkey % 2 = 0 THEN 'draft' ELSE 'qualified' END AS state FROM supplier)""")
def state_transitions(t) -> DataFrame:
    was = F.when(F.col("s_nationkey") % 2 == 0, "draft").otherwise("qualified")
    return t("supplier").select("s_suppkey", F.when((was == "draft") & (F.col("s_acctbal") > 0), "qualified").when((was == "qualified") & (F.col("s_acctbal") < -500), "deferred").otherwise(was).alias("state"))


@query("""
WITH s AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'view') AS ok, max(ts) FILTER (WHERE event_type = 'error') AS bad, arg_max(event_id, ts) FILTER (WHERE event_type IN ('view', 'error')) AS last FROM events GROUP BY 1)
SELECT user_id, ok AS last_success, bad AS last_failure, ok IS NOT NULL AND (bad IS NULL OR ok >= bad) AS healthy FROM s""")
def source_health(t) -> DataFrame:
    """Sources with the times of their last success and failure, moved by the results of runs."""
    results = t("events").where("event_type in ('view', 'error')").groupBy("user_id", "event_type").agg(F.max("ts").alias("at"))
    sources = t("events").select("user_id").distinct().withColumns({"last_success": F.lit(None).cast("timestamp_ntz"), "last_failure": F.lit(None).cast("timestamp_ntz"), "message": F.lit(None).cast("string")})
    for kind, ok in (("view", True), ("error", False)):
        sources = apply.touched(sources, results.where(F.col("event_type") == kind).select("user_id", F.lit(ok).alias("ok"), "at", F.lit(kind).alias("message")), "user_id")
    return sources.select("user_id", "last_success", "last_failure", apply.healthy().alias("healthy"))


@query("""
SELECT coalesce(a.user_id, b.user_id) AS user_id, concat_ws(',', 'kind=' || coalesce(b.kind, a.kind), 'owner=' || b.owner, 'seen=' || a.seen) AS metadata
FROM (SELECT user_id, min(event_type) AS kind, count(*) AS seen FROM events WHERE value < 60 GROUP BY 1) a FULL JOIN (SELECT user_id, max(event_type) AS kind, concat('u', user_id) AS owner FROM events WHERE value >= 30 GROUP BY 1) b ON a.user_id = b.user_id""")
def source_metadata(t) -> DataFrame:
    """Get or create with merged metadata, entries in order."""
    e = t("events")
    old = e.where("value < 60").groupBy("user_id").agg(F.create_map(F.lit("kind"), F.min("event_type"), F.lit("seen"), F.count("*").cast("string")).alias("metadata"))
    new = e.where("value >= 30").groupBy("user_id").agg(F.create_map(F.lit("kind"), F.max("event_type"), F.lit("owner"), F.concat(F.lit("u"), text("user_id"))).alias("metadata"))
    merged = apply.merged_metadata(old, new, "user_id")
    return merged.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("metadata"))


@query("""
SELECT 'rows' AS control, (SELECT count(*) FROM lineitem) AS stated, count(*) AS found, true AS ok FROM lineitem
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders) + 1, count(DISTINCT l_orderkey), count(DISTINCT l_orderkey) = (SELECT count(*) FROM orders) + 1 FROM lineitem""")
def control_totals(t) -> DataFrame:
    """Totals that a source states beside those of its rows; a false one stops an apply."""
    orders = t("orders").agg((F.count("*") + 1).alias("stated"))
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("orders"))
    both = lines.crossJoin(orders)  # one row each
    return both.select(F.explode(F.array(F.struct(F.lit("rows").alias("control"), F.col("rows").alias("stated"), F.col("rows").alias("found")), F.struct(F.lit("orders").alias("control"), F.col("stated"), F.col("orders").alias("found")))).alias("x")).select("x.*", (F.col("x.stated") == F.col("x.found")).alias("ok"))
