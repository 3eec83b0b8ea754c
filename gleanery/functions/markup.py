"""Pages as streams of markup tokens: text lines, headings and tables. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One token each: a comment, a script or style with what it holds, a tag, text, a lone "<".
TOKEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|</?[a-zA-Z!?][^>]*>|[^<]+|<"
#: Tags that end a line.
BREAK = r"(?i)^<(?:br\s*/?|/(?:p|div|li|h[1-6]|section|article|tr|table|ul|ol))\s*>$"
# The named entities that are decoded.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "–", "mdash": "—"}


def tokens(html: Column) -> Column:
    """The tokens of a page, in order; joined they are the page."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def decoded(text: Column) -> Column:
    """``text`` with numeric and the common named entities decoded, each once.

    Numbers that are no character (0, surrogates, beyond 10FFFF) and other names stay as they are.
    """
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^#([0-9]{1,7});", 1)
        hexed = F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexed != "", F.conv(hexed, 16, 10).cast("int"))
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        known = F.try_element_at(named, F.lower(F.regexp_extract(part, "^([A-Za-z]+);", 1)))
        rest = F.regexp_replace(part, "^[^;]*;", "")
        return F.when(real, F.concat(char, rest)).when(known.isNotNull(), F.concat(known, rest)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\u00a0\\s]+", " "))


def _flat(parts: Column) -> Column:
    """Tokens as text: a line end for each tag that breaks lines, a blank for every other."""
    tag = lambda t: t.startswith("<") & (F.length(t) > 1)
    return F.array_join(F.transform(parts, lambda t: F.when(~tag(t), t).when(F.regexp_like(t, F.lit(BREAK)), "\n").otherwise(" ")), "")


def lines(html: Column) -> Column:
    """The visible lines of a page, without blank ones."""
    split = F.split(decoded(_flat(tokens(html))), "\r?\n")
    return F.filter(F.transform(split, _tidy), lambda x: x != "")


def heading(html: Column) -> Column:
    """The text of the first h1; empty without one."""
    return _tidy(decoded(_flat(tokens(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)))))


def table_rows(html: Column) -> Column:
    """The rows of all tables of a page as arrays of cell texts."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: _tidy(decoded(_flat(tokens(c)))))
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), cells)


def table_sets(pages: DataFrame, html: str, key: int, values: dict[str, int]) -> DataFrame:
    """``key`` and, for each value column (name: place of its cell), the ordered set of its texts over all pages.

    Rows without a key are left out, blank cells too.
    """
    rows = pages.select(F.explode(table_rows(F.col(html))).alias("r"))
    cell = lambda i: F.nullif(F.get("r", F.lit(i)), F.lit(""))
    named = rows.select(cell(key).alias("key"), *[cell(i).alias(n) for n, i in values.items()]).where("key is not null")
    return named.groupBy("key").agg(*[F.array_sort(F.collect_set(n)).alias(n) for n in values])
