"""A table published in generations: readers stay on one, a commit is one rename.

Below the table's folder, ``data`` holds a folder for each write and ``manifests`` a small
JSON file for each generation, which names its data and counts what changed. The highest
manifest is the current one. It is written aside and renamed without overwriting, so it is
there whole or not at all, and of two writers that began at the same generation one fails.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.snapshot import digest


class Conflict(RuntimeError):
    """Another writer has committed this generation."""


class Generations:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    # Files.

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        folder = self._at("manifests")
        if not self._fs().exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs().listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n[0].isdigit() and n.endswith(".json"))

    def _commit(self, manifest: dict) -> None:
        aside, target = self._at("manifests", f"_{uuid.uuid4().hex}"), self._at("manifests", f"{manifest['generation']:010d}.json")
        out = self._fs().create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs().getUri(), self._conf).rename(aside, target, options)
        except Exception as error:
            self._fs().delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"generation {manifest['generation']} is there already") from error
            raise

    # Readers.

    def manifest(self, generation: int | None = None) -> dict | None:
        """What a generation holds; by default the current one. None where there is none."""
        numbers = self._numbers()
        if generation is None:
            generation = numbers[-1] if numbers else None
        if generation is None or generation not in numbers:
            return None
        lines = self.spark.read.text(str(self._at("manifests", f"{generation:010d}.json").toString()), wholetext=True)
        return json.loads(lines.first()["value"])  # one small file

    def read(self, generation: int | None = None) -> DataFrame | None:
        """The rows of a generation. The frame stays with it, whatever is committed later."""
        at = self.manifest(generation)
        return None if at is None else self.spark.read.parquet(f"{self.path}/data/{at['data']}")

    # Writers.

    def _compared(self, new: DataFrame, hashed: str) -> DataFrame:
        """Keys of both sides with their hashes and the old row's generation."""
        mine = new.select(F.col(self.key), F.col(hashed).alias("__new"), F.lit(True).alias("__there"))
        old = self.read()
        if old is None:
            return mine.select(self.key, "__new", "__there", F.lit(None).cast("string").alias("__old"), F.lit(None).cast("long").alias("__since"))
        return mine.join(old.select(self.key, F.col(hashed).alias("__old"), F.col("generation").alias("__since")), self.key, "full_outer")

    def plan(self, new: DataFrame, hashed: str = "content_hash") -> dict:
        """How many rows a sync would add, change, keep and remove; nothing is written."""
        both = self._compared(new, hashed)
        there, known, same = F.col("__there").isNotNull(), F.col("__since").isNotNull(), F.col("__old").eqNullSafe(F.col("__new"))
        counts = {"new": there & ~known, "changed": there & known & ~same, "unchanged": there & known & same, "removed": ~there}
        return both.agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).first().asDict()

    def sync(self, new: DataFrame, hashed: str = "content_hash", apply: bool = True) -> dict:
        """Make ``new`` the next generation, whole; the manifest (or what it would be) comes back.

        ``new`` has unique keys and a hash of each row's content. New and changed rows get
        the number of the generation, others keep theirs, vanished rows go. Where nothing
        differs no row is written: the next manifest names the same data. A write that
        fails, by a gate in ``new`` or otherwise, leaves the current generation as it is.
        """
        current = self.manifest()
        number = current["generation"] + 1 if current else 1
        counts = self.plan(new, hashed)
        out = {"generation": number, "apply": apply, **counts, "rows": counts["new"] + counts["changed"] + counts["unchanged"], "applied": 0}
        if not apply:
            return out | {"generation": number - 1}
        if current and not (counts["new"] or counts["changed"] or counts["removed"]):
            out |= {"data": current["data"], "hash": current["hash"]}
        else:
            name = f"{number:010d}-{uuid.uuid4().hex}"
            rows = new.drop("generation")
            if current:
                before = self.read().select(self.key, F.col(hashed).alias("__old"), F.col("generation").alias("__since"))
                same = F.col("__since").isNotNull() & F.col("__old").eqNullSafe(F.col(hashed))
                rows = rows.join(before, self.key, "left").withColumn("generation", F.when(same, F.col("__since")).otherwise(F.lit(number).cast("long"))).drop("__old", "__since")
            else:
                rows = rows.withColumn("generation", F.lit(number).cast("long"))
            rows.write.parquet(f"{self.path}/data/{name}")
            written = self.spark.read.parquet(f"{self.path}/data/{name}")
            hashes = digest(written, [self.key, hashed]).first()  # none where the table is empty
            out |= {"data": name, "hash": hashes["digest"] if hashes else hashlib.sha256(b"").hexdigest(), "applied": counts["new"] + counts["changed"]}
        self._commit(out)
        return out

    def expire(self, keep: int) -> int:
        """Delete the data and manifests of all but the last ``keep`` generations, and data that no manifest names."""
        numbers = self._numbers()
        kept = {self.manifest(n)["data"] for n in numbers[-keep:]}
        gone = 0
        for status in self._fs().listStatus(self._at("data")):
            if status.getPath().getName() not in kept:
                gone += self._fs().delete(status.getPath(), True)
        for n in numbers[:-keep]:
            self._fs().delete(self._at("manifests", f"{n:010d}.json"), False)
        return gone
