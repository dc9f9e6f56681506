"""Parquet tables whose rows can be replaced bucket by bucket.

A commit writes the new content of the buckets it touches into a fresh folder
and then publishes a manifest that says which folder holds each bucket.  Readers
follow the newest manifest, so they see the old rows until the new ones are
complete, and never both.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import shuffles_released, unsorted_writes
from lodestone.sources import files


GROUP_BYTES = 32 * 1024 * 1024  # of a row group, which each file that a task writes at once gathers
STAGED_HOURS = 24.0 * 7  # a writer takes no longer between its first staged row and its manifest


class WriteConflict(RuntimeError):
    """Another writer published first; read again and retry."""


@dataclass
class Manifest:
    version: int = 0
    schema_version: int = 0
    folders: dict[int, str] = field(default_factory=dict)
    text_index: dict | None = None  # the state of the keyword index these rows have


class SnapshotTable:
    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, bucket_by: str | None = None, buckets: int = 1
    ) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        self.bucket_by, self.buckets = bucket_by, buckets
        # Columns whose files carry bloom filters, so equality filters skip row groups.
        self.indexed: set[str] = set()

    def bucket(self, key: Column | None = None) -> Column:
        if self.bucket_by is None:
            return F.lit(0)
        key = F.col(self.bucket_by) if key is None else key
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> Manifest:
        names = [n for n, *_ in files.list_dir(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        if not names:
            return Manifest()
        stored = json.loads(files.read_text(self.spark, f"{self.path}/manifest/{max(names)}"))
        folders = {int(b): f for b, f in stored["folders"].items()}
        return Manifest(stored["version"], stored["schema_version"], folders, stored.get("text_index"))

    def read(self, buckets: Iterable[int] | None = None, at: Manifest | None = None) -> DataFrame:
        """Current rows, optionally of some buckets only; other folders are not opened."""
        at = at or self.manifest()
        wanted = at.folders if buckets is None else {b: at.folders[b] for b in buckets if b in at.folders}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(wanted.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the given key values; at most ``buckets`` numbers."""
        return [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]

    def commit(
        self,
        rows: DataFrame | None,
        touched: Iterable[int] | None = None,
        base: Manifest | None = None,
        schema_version: int | None = None,
        text_index: dict | None = None,
        held: DataFrame | None = None,
    ) -> Manifest:
        """Publish ``rows`` as the whole content of the touched buckets (all by default).

        ``held`` are further rows that come from the table's own files: each file has
        one bucket, so they are written where they are read and not shuffled.
        ``base`` is the manifest the rows were computed from.  A ``text_index`` is
        published with them; without one that of ``base`` stays.
        """
        base = base or self.manifest()
        folder = f"commit={base.version + 1}-{uuid.uuid4().hex[:8]}"
        placed = lambda some: some.select(*self.schema.fieldNames(), self.bucket().alias("bucket"))
        sides = [placed(held)] if held is not None else []
        sides += [placed(rows).hint("rebalance", "bucket")] if rows is not None else []
        self._write(reduce(DataFrame.unionByName, sides), f"{self.path}/data/{folder}")
        return self._publish_folder(folder, touched, base, schema_version, text_index)

    def _write(self, placed: DataFrame, target: str) -> None:
        writer = placed.write.mode("append").option("parquet.block.size", GROUP_BYTES)
        for column in self.indexed:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option("compression", "zstd").option("maxRecordsPerFile", 1_000_000).partitionBy("bucket")
        # A task's few buckets are written side by side: sorting whole rows by bucket would spill them at size.
        with shuffles_released(self.spark), unsorted_writes(self.spark):
            writer.parquet(target)

    def _publish_folder(
        self, folder: str, touched: Iterable[int] | None, base: Manifest, schema_version: int | None = None, text_index: dict | None = None
    ) -> Manifest:
        """Publish a folder of ``data`` as the whole content of the touched buckets."""
        gone = set(base.folders) if touched is None else set(touched)
        kept = {b: f for b, f in base.folders.items() if b not in gone}
        for name, *_ in files.list_dir(self.spark, f"{self.path}/data/{folder}"):
            if name.startswith("bucket="):
                kept[int(name.removeprefix("bucket="))] = folder
        version = base.schema_version if schema_version is None else schema_version
        return self._publish(Manifest(base.version + 1, version, kept, text_index or base.text_index))

    def stage(self, rows: DataFrame, dealt: bool, folder: str | None = None) -> str:
        """Write rows by bucket where no reader looks, to be published once they are known to be good; returns the folder.

        Rows that are ``dealt`` already, a bucket or few to a task, are not shuffled.
        Columns beyond the table's own are stored too, and readers pass over them.
        """
        folder = folder or f"staged-{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self.bucket())
        self._write(placed if dealt else placed.hint("rebalance", "bucket"), f"{self.path}/staged/{folder}")
        return folder

    def staged_buckets(self, folder: str) -> list[int]:
        names = [n for n, *_ in files.list_dir(self.spark, f"{self.path}/staged/{folder}")]
        return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]

    def read_staged(self, folder: str, schema: T.StructType | None = None) -> DataFrame:
        schema = schema or self.schema
        buckets = self.staged_buckets(folder)
        if not buckets:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/staged/{folder}/bucket={b}" for b in buckets])

    def publish_staged(self, staged: str, touched: Iterable[int], base: Manifest, text_index: dict | None = None) -> Manifest:
        """Publish staged rows as the whole content of the touched buckets; these are all that they have rows of."""
        folder = f"commit={base.version + 1}-{uuid.uuid4().hex[:8]}"
        files.rename(self.spark, f"{self.path}/staged/{staged}", f"{self.path}/data/{folder}")
        return self._publish_folder(folder, touched, base, None, text_index)

    def _publish(self, new: Manifest) -> Manifest:
        body = {"version": new.version, "schema_version": new.schema_version, "folders": new.folders, "text_index": new.text_index}
        if not files.write_new(self.spark, f"{self.path}/manifest/{new.version:012d}.json", json.dumps(body)):
            raise WriteConflict(f"version {new.version} of {self.path} was published by another writer")
        return new

    def rewrite(self, change: Callable[[DataFrame], DataFrame], buckets: Iterable[int] | None = None, sized: bool = False) -> Manifest:
        """Replace the content of some or all buckets by a function of it; ``sized``: into well-sized files, by a shuffle."""
        base = self.manifest()
        chosen = list(base.folders) if buckets is None else list(buckets)
        if not chosen:
            return base
        rows = change(self.read(chosen, base))
        if sized:
            return self.commit(rows, chosen, base)
        return self.commit(None, chosen, base, held=rows)

    def compact(self) -> Manifest:
        """Rewrite every bucket into well-sized files."""
        return self.rewrite(lambda rows: rows, sized=True)

    def migrate(self, steps: dict[int, Callable[[DataFrame], DataFrame] | None]) -> int:
        """Apply the steps above the stored schema version, in order and without gaps.

        A step of None only adds nullable columns: reads match columns by name,
        so the files stay as they are.
        """
        if sorted(steps) != list(range(1, len(steps) + 1)):
            raise ValueError(f"migrations must be numbered 1..{len(steps)} without gaps")
        base = self.manifest()
        for number in range(base.schema_version + 1, len(steps) + 1):
            change = steps[number]
            if change is None:
                base = self._publish(Manifest(base.version + 1, number, base.folders, base.text_index))
            else:
                base = self.commit(change(self.read(at=base)), None, base, number)
        return base.schema_version

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete folders no recent manifest names, older manifests, and what was staged long ago and never published."""
        names = sorted(n for n, *_ in files.list_dir(self.spark, f"{self.path}/manifest") if n.endswith(".json"))
        live: set[str] = set()
        for name in names[-keep:]:
            stored = json.loads(files.read_text(self.spark, f"{self.path}/manifest/{name}"))
            live |= set(stored["folders"].values())
        dead = [p for n, p, *_ in files.list_dir(self.spark, f"{self.path}/data") if n not in live]
        old = (time.time() - STAGED_HOURS * 3600) * 1000
        left = [p for _, p, _, modified in files.list_dir(self.spark, f"{self.path}/staged") if modified < old]
        for path in dead + left + [f"{self.path}/manifest/{n}" for n in names[:-keep]]:
            files.delete(self.spark, path)
        return dead

    def drop(self) -> None:
        files.delete(self.spark, self.path)
