"""The chunk table of one collection."""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.skew import less_keys, with_keys
from lodestone.schemas import CHUNKS
from lodestone.session import work_path
from lodestone.sources import files
from lodestone.sources.snapshots import Manifest, SnapshotTable
from lodestone.sources.text_index import IndexState, TextIndex

DEFAULT_BUCKETS = 64


class ChunkStore(SnapshotTable):
    """Chunks bucketed by document, so a document's change rewrites one bucket.

    A store created with ``text_index`` keeps a keyword index of the chunk texts:
    every change of rows publishes the index's change with it.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        collection: str,
        buckets: int = DEFAULT_BUCKETS,
        indexed: Iterable[str] = (),
    ) -> None:
        super().__init__(spark, f"{root}/{collection}", CHUNKS, "document_id", buckets)
        self.indexed = set(indexed)
        self.words = TextIndex(spark, f"{self.path}/words")
        self.index_ms = 0  # what the last change of the index took

    def create(self, text_index: bool = False) -> Manifest:
        state = IndexState().as_json() if text_index else None
        return self.commit(self.spark.createDataFrame([], self.schema), text_index=state)

    def index_state(self, at: Manifest | None = None) -> IndexState | None:
        """The keyword index of these rows, or None where the store has none."""
        return IndexState.from_json((at or self.manifest()).text_index)

    def _index_change(self, base: Manifest, documents: DataFrame | None, old: DataFrame | None, new: DataFrame | None) -> dict | None:
        state, started = self.index_state(base), time.monotonic()
        if state is None:
            return None
        changed = self.words.change(state, documents, old, new)
        self.index_ms = int((time.monotonic() - started) * 1000)
        return changed.as_json()

    def drop_text_index(self) -> Manifest:
        """Searches read chunk texts from here on."""
        base = self.manifest()
        files.delete(self.spark, self.words.path)
        return self._publish(Manifest(base.version + 1, base.schema_version, base.folders, None))

    def create_text_index(self) -> Manifest:
        """Index the chunks the store has, and keep the index from here on."""
        base = self.manifest()
        state = self.words.change(IndexState(), None, None, self.read(at=base)).as_json()
        return self._publish(Manifest(base.version + 1, base.schema_version, base.folders, state))

    def replace_documents(self, documents: DataFrame, rows: DataFrame, base: Manifest | None = None) -> Manifest:
        """Swap all chunks of ``documents(document_id)`` for ``rows``."""
        base = base or self.manifest()
        if self.index_state(base) is not None:
            return self._replace_staged(documents, self.stage(rows.select(*self.schema.fieldNames()), dealt=False), base)
        touched = self.touched(documents)
        return self._without(self.read(touched, base), documents.select("document_id").distinct(), rows, touched, base, None)

    def _without(self, held: DataFrame, keys: DataFrame, rows: DataFrame | None, touched: list[int], base: Manifest, words: dict | None) -> Manifest:
        """Publish ``held`` less the rows of ``keys``, and ``rows``; ``held`` is shuffled only where :func:`less_keys` has to."""
        others, in_place = less_keys(held, keys)
        others = others.select(*self.schema.fieldNames())
        if in_place:
            return self.commit(rows, touched, base, text_index=words, held=others)
        return self.commit(others if rows is None else others.unionByName(rows), touched, base, text_index=words)

    def replace_staged(self, documents: DataFrame, staged: str, refused: DataFrame, base: Manifest | None = None) -> Manifest:
        """Swap all chunks of ``documents(document_id)`` for the staged rows, less those of the documents ``refused``.

        Staged files are published as they are where nothing was refused; else each is
        written again without its refused rows.  Other documents' rows of the same
        buckets join them, file by file.
        """
        base = base or self.manifest()
        if not refused.isEmpty():
            kept, in_place = less_keys(self.read_staged(staged), refused)
            first, staged = staged, self.stage(kept, dealt=in_place)
            files.delete(self.spark, f"{self.path}/staged/{first}")
        return self._replace_staged(documents, staged, base)

    def _replace_staged(self, documents: DataFrame, staged: str, base: Manifest) -> Manifest:
        touched, rows = self.touched(documents), self.read_staged(staged)
        held, path = self.read(touched, base), work_path(self.spark, "named")
        documents.select("document_id").distinct().write.parquet(path)
        named = self.spark.read.schema("document_id string").parquet(path)
        # The index reads what was staged: what made the rows runs once, and texts are shuffled for no key.
        words = self._index_change(base, named, with_keys(held, named), rows)
        if any(b in base.folders for b in touched):
            others, in_place = less_keys(held, named)
            self.stage(others, in_place, staged)
        files.delete(self.spark, path)
        return self.publish_staged(staged, touched, base, words)

    def append(self, rows: DataFrame) -> Manifest:
        base = self.manifest()
        if self.index_state(base) is None:
            touched = self.touched(rows)
            return self.commit(rows, touched, base, held=self.read(touched, base))
        staged = self.stage(rows.select(*self.schema.fieldNames()), dealt=False)
        touched = self.staged_buckets(staged)
        words = self._index_change(base, None, None, self.read_staged(staged))
        if any(b in base.folders for b in touched):
            self.stage(self.read(touched, base), True, staged)
        return self.publish_staged(staged, touched, base, words)

    def delete_documents(self, documents: DataFrame) -> Manifest:
        return self.replace_documents(documents, self.spark.createDataFrame([], self.schema))

    def delete_chunks(self, ids: DataFrame) -> Manifest:
        """Remove ``ids(document_id, id)``; chunks of other documents are not touched."""
        base = self.manifest()
        touched = self.touched(ids)
        held = self.read(touched, base)
        lost = ids.select("document_id", "id").distinct()
        named = ids.select("document_id").distinct()
        of_named = with_keys(held, named)
        words = self._index_change(base, named, of_named, less_keys(of_named, lost)[0])
        return self._without(held, lost, None, touched, base, words)

    def update_document(self, document_id: str, changes: dict[str, Column | None]) -> Manifest:
        """Set columns on every chunk of a document; None sets NULL, absent columns stay."""
        mine = F.col("document_id") == document_id
        types = {f.name: f.dataType for f in self.schema.fields}

        def patched(rows: DataFrame) -> DataFrame:
            cols = {
                c: F.when(mine, (F.lit(None) if v is None else v).cast(types[c])).otherwise(F.col(c))
                for c, v in changes.items()
            }
            return rows.withColumns(cols)

        key = self.spark.createDataFrame([(document_id,)], "document_id string")
        return self.rewrite(patched, self.touched(key))

    def null_slot(self, column: str) -> Manifest:
        """Clear a metadata slot on every chunk before it is given to another field."""
        kind = self.schema[column].dataType
        return self.rewrite(lambda rows: rows.withColumn(column, F.lit(None).cast(kind)))

    def index_slot(self, column: str) -> Manifest:
        """Clear a slot for its new field and index it from here on."""
        return self.index_slots([column])

    def index_slots(self, columns: Sequence[str]) -> Manifest:
        """Index slots from here on; those that still hold values are cleared in one rewrite, unused ones cost none."""
        self.indexed |= set(columns)
        base = self.manifest()
        if not columns or not base.folders:
            return base
        held = self.read(at=base).agg(*[F.count(c).alias(c) for c in columns]).first()
        used = [c for c in columns if held[c]]
        if not used:
            return base
        blank = {c: F.lit(None).cast(self.schema[c].dataType) for c in used}
        return self.rewrite(lambda rows: rows.withColumns(blank))

    def drop_slot(self, column: str) -> Manifest:
        """Clear the slot of a deleted field and stop indexing it."""
        self.indexed.discard(column)
        return self.null_slot(column)
