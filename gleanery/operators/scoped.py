"""Scoped reconciliation: records of one country and two identity schemes, to providers and courses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import exprs

# The states of a course, and schemes that classify courses and can't identify them in Canada.
LIFECYCLE = ("active", "suspended", "inactive", "unknown")
CLASSIFYING = ("on_aps", "aps", "mtcu", "cip", "cip_2021")


def ruled(country: str, provider_scheme: str, course_scheme: str) -> tuple[str, str]:
    """The schemes in lower case; a scheme that the country's rules forbid is an error."""
    provider, course = ((s or "").strip().lower() for s in (provider_scheme, course_scheme))
    if not provider or not course:
        raise ValueError("provider and course identity schemes are required")
    if country.upper() == "CA" and provider != "ircc_dli":
        raise ValueError("providers in Canada are identified by ircc_dli")
    if country.upper() == "CA" and course in CLASSIFYING:
        raise ValueError(f"{course} classifies courses, it can't identify them")
    return provider, course


def cleaned(records: DataFrame) -> DataFrame:
    """``records`` with clean values, and ``conflict``: no code or name, or an unknown lifecycle."""
    rows = records.select(
        "ord",
        F.upper(exprs.clean(F.col("provider_code"))).alias("provider_code"),
        exprs.clean(F.col("provider_name")).alias("provider_name"),
        exprs.clean(F.col("course_code")).alias("course_code"),
        exprs.clean(F.col("title")).alias("title"),
        F.lower(F.coalesce(exprs.clean(F.col("lifecycle")), F.lit("active"))).alias("lifecycle"),
        F.lower(exprs.clean(F.col("reg_scheme"))).alias("reg_scheme"),
        exprs.clean(F.col("reg_code")).alias("reg_code"),
    )
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("provider_code", "provider_name", "course_code", "title")]) & F.col("lifecycle").isin(*LIFECYCLE)
    return rows.withColumn("conflict", ~whole)


def with_known(rows: DataFrame, providers: DataFrame, courses: DataFrame | None) -> DataFrame:
    """``rows`` with the ids that are known as ``__p`` and ``__c``."""
    rows = rows.join(providers.select(F.upper("code").alias("provider_code"), F.col("id").cast("string").alias("__p")), "provider_code", "left")
    if courses is None:
        return rows.withColumn("__c", F.lit(None).cast("string"))
    return rows.join(courses.select("provider_code", "course_code", F.col("id").cast("string").alias("__c")), ["provider_code", "course_code"], "left")


def part(code: str) -> Column:
    """A code as a part of a key: no colon is in it."""
    return F.lower(F.regexp_replace(code, "[^a-zA-Z0-9]+", "-"))


def reconciled(records: DataFrame, country: str, provider_scheme: str, course_scheme: str, providers: DataFrame, courses: DataFrame | None = None) -> DataFrame:
    """``records`` cleaned, with keys, ids and outcomes for provider and course.

    Records: ord (unique), provider_code, provider_name, course_code, title, lifecycle,
    reg_scheme, reg_code. ``providers``: code and id; ``courses``: provider_code, course_code
    and id. A record without a code or name, or with an unknown lifecycle, is a conflict. The
    first record of a key that is not known creates it, later ones find it.
    """
    country = country.lower()
    p_scheme, c_scheme = ruled(country, provider_scheme, course_scheme)
    rows = cleaned(records)
    provider_key = F.concat_ws(":", F.lit("provider"), F.lit(country), F.lit(p_scheme), part("provider_code"))
    course_key = F.concat_ws(":", F.lit("course"), F.lit(country), F.lit(p_scheme), part("provider_code"), F.lit(c_scheme), part("course_code"))
    good = rows.where("not conflict").withColumns({"provider_key": provider_key, "course_key": course_key})
    ends = lambda key: good.groupBy(key).agg(F.min("ord").alias(f"__first_{key}"))
    good = good.join(ends("provider_key"), "provider_key").join(ends("course_key"), "course_key")
    good = with_known(good, providers, courses)
    named = exprs.uuid_v5(F.concat_ws(":", F.lit("coursefinder"), F.lit(country), F.lower("provider_code"), F.lit(c_scheme), F.lower("course_code")))
    outcome = lambda mine, key: F.when(F.col(mine).isNull() & (F.col("ord") == F.col(f"__first_{key}")), "created").otherwise("existing")
    good = good.withColumns({"provider_id": F.coalesce("__p", F.md5("provider_key")), "course_id": F.coalesce("__c", named), "provider_outcome": outcome("__p", "provider_key"), "course_outcome": outcome("__c", "course_key")})
    return good.drop("__p", "__c", "__first_provider_key", "__first_course_key").unionByName(rows.where("conflict"), allowMissingColumns=True)


NAMES = ["records", "conflicts", *[f"lifecycle_{x}" for x in LIFECYCLE], "provider_created", "provider_existing", "course_created", "course_existing"]


def named(one: DataFrame) -> DataFrame:
    """One row of counts as rows of ``name`` and ``n``."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in NAMES])).alias("x")).select("x.*")


def tallied(records: DataFrame, country: str, provider_scheme: str, course_scheme: str, providers: DataFrame, courses: DataFrame | None = None) -> DataFrame:
    """What ``counted`` counts of ``reconciled`` records, in one pass by course and provider, without their keys and ids.

    A key is created if its first record finds no id: if the least ``ord`` of those that
    find none is the least of all. Conflicts have no codes here and are one group, summed
    where they are read.
    """
    ruled(country, provider_scheme, course_scheme)
    good = lambda c: F.when(~F.col("conflict"), c)
    rows = cleaned(records).withColumns({"provider_code": good(F.col("provider_code")), "course_code": good(F.col("course_code"))})
    unknown = lambda c: F.when(~F.col("conflict") & F.col(c).isNull(), F.col("ord"))
    lives = [f"lifecycle_{x}" for x in LIFECYCLE]
    counts = [F.count_if(~F.col("conflict") & (F.col("lifecycle") == x)).alias(name) for x, name in zip(LIFECYCLE, lives)]
    by_course = with_known(rows, providers, courses).groupBy(part("provider_code").alias("p"), part("course_code").alias("c")).agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.min(unknown("__p")).alias("p_made"), F.min(unknown("__c")).alias("c_made"), *counts)
    made = F.col("p").isNotNull() & F.coalesce(F.col("c_made") == F.col("first"), F.lit(False))
    sums = [F.sum(x).alias(x) for x in ["n", *lives]]
    by_provider = by_course.groupBy("p").agg(F.min("first").alias("first"), F.min("p_made").alias("p_made"), F.count_if(made).alias("course_created"), *sums)
    made = F.col("p").isNotNull() & F.coalesce(F.col("p_made") == F.col("first"), F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = by_provider.agg(total("n").alias("records"), total(F.when(F.col("p").isNull(), F.col("n"))).alias("conflicts"), *[total(x).alias(x) for x in lives], F.count_if(made).alias("provider_created"), total("course_created").alias("course_created"))
    kept = F.col("records") - F.col("conflicts")
    return named(one.withColumns({"provider_existing": kept - F.col("provider_created"), "course_existing": kept - F.col("course_created")}))


def counted(rows: DataFrame) -> DataFrame:
    """``name``, ``n``: records, conflicts, created and existing providers and courses, records by lifecycle."""
    good = ~F.col("conflict")
    counts = {"records": F.lit(True), "conflicts": F.col("conflict")}
    counts |= {f"lifecycle_{x}": good & (F.col("lifecycle") == x) for x in LIFECYCLE}
    one = rows.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    for who in ("provider", "course"):
        # By key first: records of one ``ord`` create one.
        keys = rows.where(good).groupBy(f"{who}_key").agg(F.max((F.col(f"{who}_outcome") == "created").cast("int")).alias("made"), F.count("*").alias("n"))
        made = keys.agg(F.coalesce(F.sum("made"), F.lit(0)).alias(f"{who}_created"), F.coalesce(F.sum(F.col("n") - F.col("made")), F.lit(0)).alias(f"{who}_existing"))
        one = one.crossJoin(made)  # one row each
    return named(one)


def courses(rows: DataFrame) -> DataFrame:
    """One row for each course, with the title and lifecycle of its last record."""
    last = F.max_by(F.struct("course_id", "provider_id", "provider_code", "course_code", "title", "lifecycle"), "ord").alias("r")
    return rows.where("not conflict").groupBy("course_key").agg(last).select("course_key", "r.*")


def identifiers(rows: DataFrame, provider_scheme: str, course_scheme: str) -> DataFrame:
    """``relation``, ``owner``, ``scheme``, ``code``: identifiers and registrations, one row each.

    A regional code is a registration of the course and never identifies it.
    """
    good = rows.where("not conflict")
    provider = good.select(F.explode(F.array(F.lit("provider_identifier"), F.lit("provider_registration"))).alias("relation"), F.col("provider_id").alias("owner"), F.lit(provider_scheme).alias("scheme"), F.col("provider_code").alias("code"))
    course = good.select(F.lit("course_identifier").alias("relation"), F.col("course_key").alias("owner"), F.lit(course_scheme).alias("scheme"), F.col("course_code").alias("code"))
    regional = good.where("reg_scheme is not null and reg_code is not null").select(F.lit("course_registration").alias("relation"), F.col("course_key").alias("owner"), F.col("reg_scheme").alias("scheme"), F.col("reg_code").alias("code"))
    return provider.unionByName(course).unionByName(regional).distinct()
