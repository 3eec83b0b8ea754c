"""Readers of source files: CSV, JSON, ZIP, XLSX and HTML, all into DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators import gates
from gleanery.session import ship


def header(name: str) -> str:
    """A header as lower-case words joined by underscores."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower().lstrip("﻿")).strip("_")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180 records as texts, headers normalised, blank rows dropped.

    As a quoted value may hold line ends, one task reads a file; give many files.
    """
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    df = df.toDF(*[header(c) for c in df.columns])
    filled = [F.coalesce(F.trim(c), F.lit("")) != "" for c in df.columns]
    return df.where(F.array_contains(F.array(*filled), True))


def json_items(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """Items of JSON files: each file an array, or an object that holds one in ``field``."""
    text = spark.read.text(path, wholetext=True)
    body = F.get_json_object("value", f"$.{field}") if field else F.col("value")
    return text.select(F.explode(F.from_json(body, f"array<{schema}>")).alias("x")).select("x.*")


def nested(rows: DataFrame, array: str) -> DataFrame:
    """Parents with their items; a parent without items keeps one row."""
    return rows.select("*", F.posexplode_outer(array).alias("place", "item")).drop(array)


def paged(pages: DataFrame, page_size: int, offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit of items numbered over pages (page from 0, place).

    The pages outside are cut by a predicate on the page number.
    """
    first, last = offset // page_size, (offset + limit - 1) // page_size
    at = F.col("page") * page_size + F.col("place")
    return pages.where(F.col("page").between(first, last)).where((at >= offset) & (at < offset + limit))


def shards(spark: SparkSession, pattern: str, key: str) -> tuple[DataFrame, DataFrame]:
    """All shards of a pattern, and the keys that more than one row has."""
    df = csv(spark, pattern).withColumn("shard", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df, df.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("shard")).alias("shards")).where("n > 1")


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """``shard``, ``sha256``, ``length`` of each file of a pattern."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), F.sha2("content", 256).alias("sha256"), "length")


def whole_shards(spark: SparkSession, pattern: str, key: str, stated: DataFrame) -> DataFrame:
    """All rows of the shards that a manifest (shard, sha256) states.

    A shard that is missing, changed or not stated, and a key that two rows have, stop the
    job that reads them; what is read is all shards or none.
    """
    rows, twice = shards(spark, pattern, key)
    there = manifest(spark, pattern).select("shard", F.col("sha256").alias("found"))
    differ = stated.select("shard", "sha256").join(there, "shard", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("found")))
    return gates.without(gates.without(rows, differ, "shard", "shards differ from the manifest"), twice, key, "keys stand more than once")


def replayed(spark: SparkSession, path: str, descriptors: DataFrame) -> DataFrame:
    """Stored blobs with their descriptors (name, sha256, descriptor, descriptor_sha256), before anything is parsed.

    A descriptor that doesn't fit its own hash, and a blob that is missing or doesn't fit its
    descriptor's, stop the job. Blobs without a descriptor are left out.
    """
    bad = descriptors.where(~F.sha2(F.col("descriptor").cast("binary"), 256).eqNullSafe(F.col("descriptor_sha256")))
    blobs = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.sha2("content", 256).alias("__sha"))
    rows = gates.found(descriptors, blobs, ["name"], "blob")
    odd = rows.where(~F.col("sha256").eqNullSafe(F.col("__sha")))
    return gates.without(gates.without(rows.drop("__sha"), bad, "name", "descriptors differ from their hashes"), odd, "name", "blobs differ from their descriptors")


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """archive, member, content of the members whose names match ``pattern``."""
    ship(spark)

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if re.search(pattern, member, re.I):
                            yield pd.DataFrame({"archive": [name], "member": [member], "content": [archive.read(member)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, member string, content binary")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet, row number from 1 and cell texts of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS):
            part = "xl/" + targets[sheet.get(f"{{{_NS['r']}}}id")].removeprefix("/xl/")
            for row in ElementTree.fromstring(book.read(part)).iterfind("m:sheetData/m:row", _NS):
                cells: list[str | None] = []
                for c in row:
                    letters = re.match("[A-Z]+", c.get("r", "A")).group()
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    cells += [None] * (at - len(cells))
                    value = c.findtext("m:v", None, _NS)
                    if c.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    cells[at - 1] = value
                yield sheet.get("name"), int(row.get("r")), cells


def xlsx(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, cells of workbooks; one task reads a workbook."""
    ship(spark)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                yield pd.DataFrame([(name, *r) for r in sheet_rows(content)], columns=["file", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, sheet string, row long, cells array<string>")


def header_row(rows: DataFrame, weights: dict[str, int], first: int | None = None) -> DataFrame:
    """file, sheet and row of the best header: cell patterns score, the best sheet wins.

    ``first``: look at so many rows of a sheet only.
    """
    cell = lambda p: F.exists("cells", lambda x: F.regexp_like(F.coalesce(x, F.lit("")), F.lit(f"(?i){p}"))).cast("int")
    score = sum((cell(p) * w for p, w in weights.items()), F.lit(0))
    w = Window.partitionBy("file").orderBy(F.desc("score"), "sheet", "row")
    seen = rows if first is None else rows.where(F.col("row") <= first)
    return seen.withColumn("score", score).withColumn("r", F.row_number().over(w)).where("r = 1 and score > 0").select("file", "sheet", "row", "score")


def html_rows(html: Column) -> Column:
    """Rows of HTML tables as arrays of cell texts."""
    from gleanery.functions.exprs import visible_text

    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), visible_text))


def html_cards(html: Column, marker: str, fields: dict[str, str]) -> Column:
    """Cards of a page, each with the first group of every field's pattern."""
    cards = F.slice(F.split(html, marker), F.lit(2), F.size(F.split(html, marker)))
    return F.transform(cards, lambda c: F.struct(*[F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")).alias(n) for n, p in fields.items()]))


def script_json(html: Column, name: str, schema: str) -> Column:
    """A JSON value that a script of a page assigns to ``name``."""
    return F.from_json(F.regexp_extract(html, rf"(?s){name}\s*=\s*([\[{{].*?[\]}}])\s*;", 1), schema)


def verified(spark: SparkSession, path: str, hashes: DataFrame) -> DataFrame:
    """Stored blobs whose SHA-256 is among ``hashes`` (sha256)."""
    blobs = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))
    return blobs.join(hashes.select("sha256"), "sha256", "left_semi")
