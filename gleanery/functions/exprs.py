"""Column expressions for cleaning, typing, keys and parsing. No Python UDFs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespace of URLs in version 5 identifiers.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _folds() -> tuple[str, str]:
    """Latin letters whose decomposition begins with a letter from a to z, and that letter."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for low, high in ((0xC0, 0x250), (0x1E00, 0x1F00), (0xFF41, 0xFF5B)) for c in range(low, high)]
    kept = [(a, d[0].lower()) for a, d in pairs if d != a and "a" <= d[0].lower() <= "z" and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


ACCENTS, PLAIN = _folds()


def clean(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def slug(c: Column) -> Column:
    """Lower-case words joined by dashes, none at the edges."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]+", "-")), "^-+|-+$", "")


def tri_state(c: Column) -> Column:
    """yes, true, y, 1 are true; no, false, n, 0 are false; all else is null."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(text.isin("yes", "true", "y", "1"), True).when(text.isin("no", "false", "n", "0"), False)


def plain_number(c: Column, kind: str = "decimal(18,2)") -> Column:
    """A number only where the whole text is one."""
    return F.when(F.regexp_like(c, F.lit(r"^[0-9]+(\.[0-9]+)?$")), c.try_cast(kind))


def amount(c: Column, kind: str = "decimal(18,2)") -> Column:
    """A number after currency signs and separators are scrubbed."""
    return clean(F.regexp_replace(c, "[^0-9.-]", "")).try_cast(kind)


def interval_cell(c: Column) -> tuple[Column, Column, Column]:
    """Value, low and high of cells such as "85.2 (83.1, 87.0)"."""
    n = r"(-?[0-9]+(?:\.[0-9]+)?)"
    bare = F.regexp_replace(c, r"(?<=[0-9]),(?=[0-9]{3})", "")
    part = lambda i: clean(F.regexp_extract(bare, rf"^\s*{n}(?:\s*\(\s*{n}\s*,\s*{n}\s*\))?\s*$", i)).try_cast("double")
    return part(1), part(2), part(3)


def suppressed(c: Column) -> tuple[Column, Column]:
    """Count and whether it was withheld ("<5")."""
    text = F.trim(c)
    hidden = F.regexp_like(text, F.lit("^<[0-9]+$"))
    return F.when(~hidden, F.regexp_replace(text, ",", "").try_cast("bigint")), F.coalesce(hidden, F.lit(False))


def uuid_v5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    byte = lambda at: F.conv(F.substring(h, at, 2), 16, 10).cast("int")
    two = lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(two(byte(13).bitwiseAND(15).bitwiseOR(80)), F.substring(h, 15, 2)), F.concat(two(byte(17).bitwiseAND(63).bitwiseOR(128)), F.substring(h, 19, 2)), F.substring(h, 21, 12))


def md5_uuid(name: Column) -> Column:
    h = F.md5(name)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def content_hash(*columns: str) -> Column:
    """SHA-256 of a row's values; nulls and empty texts differ."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]), 256)


def label(c: Column) -> Column:
    """Folded label: accents, marks, "&", case, punctuation and spaces."""
    text = F.translate(F.lower(F.replace(F.regexp_replace(c, r"\p{M}+", ""), F.lit("&"), F.lit(" and "))), ACCENTS, PLAIN)
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


# The words that are no part of a name, and the order in which titles are read.
LEGAL = (r"\([^)]*\)", r"^the ", r" (?:pty ltd|pty limited|limited|ltd|inc)$", r" australia$")
TITLES = (("phd|doctor", "doctorate"), ("master", "master"), ("graduate certificate|graduate diploma", "graduate"), ("bachelor|honours", "bachelor"), ("advanced diploma|associate degree", "advanced_diploma"), ("diploma", "diploma"), ("certificate", "certificate"))


def alias_forms(c: Column) -> Column:
    """The folded label and what is left of it as legal parts go, one form for each of three passes."""
    bare = F.regexp_replace(F.lower(c), LEGAL[0], " ")
    forms = [label(c), label(bare)]
    for _ in range(3):
        last = forms[-1]
        for p in LEGAL[1:]:
            last = F.regexp_replace(last, p, "")
        forms.append(F.trim(last))
    return F.array_sort(F.array_distinct(F.filter(F.array(*forms), lambda x: x != "")))


def study_level(title: Column) -> Column:
    """The level of the first pattern that a title fits, else other."""
    text = F.lower(title)
    out = F.when(F.regexp_like(text, F.lit(TITLES[0][0])), TITLES[0][1])
    for pattern, name in TITLES[1:]:
        out = out.when(F.regexp_like(text, F.lit(pattern)), name)
    return out.otherwise("other")


def code_and_name(c: Column) -> tuple[Column, Column]:
    """Code and name of a field such as "0203 - Computer Science"."""
    return clean(F.regexp_extract(c, r"^\s*([0-9]{2,6})\s*-", 1)), clean(F.regexp_replace(c, r"^\s*[0-9]{2,6}\s*-\s*", ""))


def level(title: Column) -> Column:
    """The first of an ordered list of patterns that a title fits."""
    rules = (("PROMO", "certificate"), ("ECONOMY", "diploma"), ("STANDARD", "bachelor"), ("MEDIUM", "master"), ("LARGE|SMALL", "doctorate"))
    out = F.when(F.regexp_like(title, F.lit(rules[0][0])), rules[0][1])
    for pattern, name in rules[1:]:
        out = out.when(F.regexp_like(title, F.lit(pattern)), name)
    return out.otherwise("other")


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, tags and common entities."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, "[ \t\r\n]+", " "))


def cleaned_codes(codes: Column) -> Column:
    """An array parameter: trimmed, lower-cased, without blanks and repeats, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(codes, lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def written_date(c: Column) -> Column:
    """The date of a text such as "Opens 12 August 2026"; null without one."""
    return F.try_to_date(F.regexp_extract(c, r"([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})", 1), "d MMMM yyyy")


def next_year(month: Column, today: Column) -> Column:
    """The year in which the named month comes next, this month counted."""
    number = F.month(F.to_date(F.concat(F.lit("1 "), month, F.lit(" 2000")), "d MMMM yyyy"))
    return F.year(today) + F.when(number >= F.month(today), 0).otherwise(1)


def json_map(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def map_merged(a: Column, b: Column) -> Column:
    """Entries of both maps, those of ``b`` win; null values are stripped."""
    kept = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    return F.map_filter(F.map_concat(kept, b), lambda k, v: v.isNotNull())


def map_without(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def map_set(m: Column, key: str, value: Column) -> Column:
    return F.map_concat(map_without(m, key), F.create_map(F.lit(key), value))


def map_json(m: Column) -> Column:
    """A map as a JSON object, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
