"""The stored keyword index of a collection: posting blocks, written change by change.

Every change of the chunks writes one *delta*: the postings of the new chunks in
blocks, how many chunks lost each term, and the documents whose older postings no
longer count.  A block holds the postings of one term for chunks of about one length
(a chunk's block follows from its length and id, for all its terms alike), with the
largest term count and the least length in it.  These bound what a chunk of the
block can score, whatever the collection's averages have become, so a search

1. reads the bounds of its terms' blocks, and no posting,
2. scores the most promising blocks, which gives the k-th best score,
3. reads those of the other blocks whose bounds reach it.

A block's chunks are numbered, and listed once with their ids and lengths: a posting
is a chunk's number and a term count.  Postings lie sorted by term and block in
folders by hash of the term, so all three reads open few folders and skip the rest of
the files by their statistics.  No chunk text is opened.  Many deltas are merged into
one from the postings alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions.text import term_counts, tokens  # noqa: F401
from lodestone.operators.keyword import B, K1, SCORE_DIGITS, bm25
from lodestone.operators.ranking import top_per_group
from lodestone.operators.skew import KEY_ROWS, fits_broadcast, lookup_join
from lodestone.session import shuffles_released, unsorted_writes, work_path
from lodestone.sources.files import delete

BLOCK = 1024  # chunks of a block, about
BLOCK_BYTES = 8 * 1024 * 1024  # of their texts, about: a task holds a block at once
FIRST_BLOCKS = 4  # scored before the bounds are used, for each query
LITERALS = 1000  # terms or blocks named in a filter, at most; more are joined
MERGE_AFTER = 16  # deltas
TERM_PARTS, CHUNK_PARTS = 4, 64  # tasks that share a term folder, and the lists of chunks
BUCKET_ROWS = 500_000  # postings of a term folder, about; a delta has 256 folders at most
POSTING_BYTES = 8  # of text for each posting, about
SCORE_VALUES = 2_000_000  # scores and parts of scores that a task adds up at once
CHUNK_BUCKET = -1  # the folder with the chunks of the blocks
LAYOUT = 2  # of the stored index; one of another layout is passed over

CHUNK = "struct<id: string, document_id: string, length: int>"
BLOCK_ROW = f"term string, block long, n long, most_tf int, least_length int, postings array<int>, chunks array<{CHUNK}>, bucket int"
# All terms of a block and folder in a row, as its numbers and terms in Zstandard: these are what moves by term.
PACKED_ROW = f"block long, bucket int, size int, packed binary, chunks array<{CHUNK}>"


@dataclass(frozen=True)
class IndexState:
    """What a reader has to know: the deltas with their folders, and the corpus totals."""

    deltas: tuple[tuple[int, str, int], ...] = ()  # number, folder, term folders
    chunks: int = 0
    tokens: int = 0

    @property
    def next_number(self) -> int:
        return max((n for n, *_ in self.deltas), default=0) + 1

    def as_json(self) -> dict:
        return {"layout": LAYOUT, "deltas": [list(d) for d in self.deltas], "chunks": self.chunks, "tokens": self.tokens}

    @staticmethod
    def from_json(stored: dict | None) -> IndexState | None:
        if stored is None or stored.get("layout") != LAYOUT:
            return None
        return IndexState(tuple((n, f, b) for n, f, b in stored["deltas"]), stored["chunks"], stored["tokens"])


def _term_bucket(buckets: int) -> Column:
    return F.pmod(F.crc32("term"), F.lit(buckets)).cast("int")


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _length_class(length: Column) -> Column:
    return F.floor(4 * F.log2(length + 1)).cast("int")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole


def _list(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)


def _table(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.Table:
    rows = len(next(iter(columns.values())))
    return pa.table({f.name: columns.get(f.name, pa.nulls(rows, f.type)) for f in schema}, schema=schema)


def _block_rows(chunks: pa.Table, buckets: int, schema: pa.Schema) -> pa.Table:
    """The packed rows of one block, and a last one that lists its chunks.

    ``words`` are a chunk's tokens, parted by blanks.  Chunks are numbered in an order of
    their own, so that a block made again is the same.
    """
    chunks = chunks.filter(pc.not_equal(chunks["words"], "")).sort_by([(c, "ascending") for c in ("id", "document_id", "words")])
    if not len(chunks):
        return schema.empty_table()
    split = pc.split_pattern(_whole(chunks["words"]), " ")
    lengths = np.diff(split.offsets.to_numpy())
    coded = split.flatten().dictionary_encode()
    bucket = np.array([crc32(t) % buckets for t in coded.dictionary.cast(pa.binary()).to_pylist()])
    order = np.argsort(bucket, kind="stable")
    rank, bucket, terms = np.argsort(order), bucket[order], coded.dictionary.take(pa.array(order))
    place = rank[coded.indices.to_numpy()] * len(chunks) + np.repeat(np.arange(len(chunks)), lengths)
    place, tf = np.unique(place, return_counts=True)
    code, number = place // len(chunks), place % len(chunks)
    starts = np.searchsorted(code, np.arange(len(terms)))
    n = np.diff(np.append(starts, len(code)))
    most, least = np.maximum.reduceat(tf, starts), np.minimum.reduceat(lengths[number], starts)
    block, rows = chunks["block"][0].as_py(), []
    for one in range(buckets):
        at, end = np.searchsorted(bucket, (one, one + 1))
        if at < end:
            some = slice(starts[at], starts[end] if end < len(starts) else len(code))
            numbers = [[end - at], n[at:end], most[at:end], least[at:end], number[some], tf[some]]
            plain = np.concatenate(numbers).astype(np.int32).tobytes() + " ".join(terms[at:end].to_pylist()).encode()
            rows.append({"block": block, "bucket": one, "size": len(plain), "packed": pa.compress(plain, "zstd", asbytes=True)})
    listed = schema.field("chunks").type.value_type
    own = pa.StructArray.from_arrays([_whole(chunks["id"]), _whole(chunks["document_id"]), pa.array(lengths.astype(np.int32))], fields=list(listed))
    last = {"block": pa.array([block]), "bucket": pa.array([CHUNK_BUCKET], pa.int32()), "chunks": _list(np.array([len(chunks)]), own)}
    return pa.concat_tables([pa.Table.from_pylist(rows, schema), _table(last, schema)])


def _folder_rows(packed: pa.Table, schema: pa.Schema) -> pa.Table:
    """The rows of the packed ones of one folder, by term and block."""
    if packed["bucket"][0].as_py() == CHUNK_BUCKET:
        return _table({c: _whole(packed[c]) for c in ("block", "bucket", "chunks")}, schema)
    found: dict[str, list] = {c: [] for c in ("n", "most_tf", "least_length", "number", "tf")}
    terms = []
    for one, size in zip(packed["packed"], packed["size"].to_pylist(), strict=True):
        plain = memoryview(pa.decompress(one.as_buffer(), size, "zstd", asbytes=True))
        count = int(np.frombuffer(plain, np.int32, 1)[0])
        numbers = np.frombuffer(plain, np.int32, 3 * count, 4).reshape(3, count)
        postings = np.frombuffer(plain, np.int32, 2 * int(numbers[0].sum()), 4 + numbers.nbytes).reshape(2, -1)
        for name, values in zip(found, (*numbers, *postings), strict=True):
            found[name].append(values)
        terms.append(str(plain[4 + numbers.nbytes + postings.nbytes :], "utf-8"))
    counts = [len(x) for x in found["n"]]
    n, most, least, number, tf = (np.concatenate(x) for x in found.values())
    coded = pc.split_pattern(pa.array([" ".join(terms)]), " ").flatten().dictionary_encode()
    rank = np.argsort(pc.sort_indices(coded.dictionary).to_numpy())
    block = np.repeat(packed["block"].to_numpy(), counts)
    order = np.lexsort((block, rank[coded.indices.to_numpy()]))
    # A term's list has the numbers of its chunks, and then the counts.
    starts, n = (np.cumsum(n) - n)[order], n[order]
    ends = np.cumsum(n)
    here = np.arange(len(number)) + np.repeat(starts - (ends - n), n)
    at = np.arange(len(number)) + np.repeat(ends - n, n)
    values = np.empty(2 * len(number), np.int32)
    values[at], values[at + np.repeat(n, n)] = number[here], tf[here]
    columns = {
        "term": coded.dictionary.take(coded.indices.take(pa.array(order))),
        "block": pa.array(block[order]),
        "n": pa.array(n.astype(np.int64)),
        "most_tf": pa.array(most[order]),
        "least_length": pa.array(least[order]),
        "postings": _list(2 * ends, pa.array(values)),
        "bucket": pa.array(np.full(len(order), packed["bucket"][0].as_py(), np.int32)),
    }
    return _table(columns, schema)


def _chunk_words(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
    """``id, document_id, words`` of the ``chunks`` of one block, from its postings."""
    terms, term, number, tf = _postings(blocks)
    kept = np.isin(number, chunks["number"].to_numpy())
    term, number, tf = term[kept], number[kept], tf[kept]
    order = np.argsort(number, kind="stable")
    counts = np.bincount(number[order], tf[order], minlength=1).astype(np.int64)
    words = pc.take(terms, pa.array(np.repeat(term[order], tf[order])))
    joined = pc.binary_join(_list(np.cumsum(counts), words), " ")
    out = chunks.select(["id", "document_id"])
    return out.append_column("words", pc.take(joined, pa.array(chunks["number"].to_numpy())).cast(pa.string()))


def _postings(blocks: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of posting rows, and for each posting the row, the chunk's number and the count."""
    lists = _whole(blocks["postings"])
    n = np.diff(lists.offsets.to_numpy()) // 2
    values, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
    starts = np.cumsum(n) - n
    at = np.arange(len(row)) + starts[row]
    terms = _whole(blocks["term"]) if "term" in blocks.column_names else None
    return terms, row, values[at], values[at + n[row]]


def _block_scores(postings: pa.Table, listed: pa.Table, chunks: int, average: float, limit: int) -> pa.Table:
    """The best ``limit`` chunks of a block for each query that asks for it, ties by id.

    ``postings`` are the rows of asked terms with their ``df`` and ``queries``, ``listed`` one row
    with the ``chunks`` that count and the ``askers``.  Scores are added up for some queries at
    a time, so what a task holds does not grow with the queries.
    """
    kind = postings.schema.field("queries").type.value_type
    out = {"query_id": [pa.array([], kind)], "id": [pa.array([], pa.string())], "document_id": [pa.array([], pa.string())], "keyword_bm25_score": [pa.array([], pa.float64())]}
    if len(postings) and len(listed):
        own = pa.Table.from_struct_array(_whole(listed["chunks"]).flatten()).sort_by([("id", "ascending"), ("document_id", "ascending")])
        ids, documents = _whole(own["id"]), _whole(own["document_id"])
        # Rows of one id and document are one chunk.
        pair = list(zip(ids.to_pylist(), documents.to_pylist(), strict=True))
        first = np.array([i == 0 or pair[i] != pair[i - 1] for i in range(len(pair))])
        ids, documents = ids.filter(pa.array(first)), documents.filter(pa.array(first))
        numbers = own["number"].to_numpy()
        _, row, number, tf = _postings(postings)
        place = np.full(max(numbers.max(), number.max(initial=0)) + 1, -1)
        place[numbers] = np.cumsum(first) - 1
        long = np.zeros(len(place))
        long[numbers] = own["length"].to_numpy()
        kept = place[number] >= 0
        row, number, tf = row[kept], number[kept], tf[kept].astype(float)
        df = postings["df"].to_numpy().astype(float)
        part = np.log(1.0 + (chunks - df + 0.5) / (df + 0.5))[row] * tf * (K1 + 1) / (tf + K1 * ((1.0 - B) + B * long[number] / average))
        at, sizes = np.searchsorted(row, np.arange(len(df))), np.bincount(row, minlength=len(df))
        place = place[number]

        askers, lists = _whole(listed["askers"]).flatten(), _whole(postings["queries"])
        query = pc.index_in(lists.flatten(), value_set=askers)
        term = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[query.is_valid().to_numpy(zero_copy_only=False)]
        query = query.drop_null().to_numpy()
        order = np.argsort(query, kind="stable")
        query, term = query[order], term[order]
        width, begin = len(ids), np.searchsorted(query, np.arange(len(askers) + 1))
        parts = np.append(0, np.cumsum(sizes[term]))[begin]
        q = 0
        while q < len(askers):
            end = min(int(np.searchsorted(parts, parts[q] + SCORE_VALUES, "right")) - 1, q + max(SCORE_VALUES // width, 1), len(askers))
            end = max(end, q + 1)
            some = slice(begin[q], begin[end])
            n = sizes[term[some]]
            met = np.repeat(at[term[some]] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
            cell = np.repeat(query[some] - q, n).astype(np.int64) * width + place[met]
            scores = np.bincount(cell, part[met], minlength=(end - q) * width).reshape(-1, width).round(SCORE_DIGITS)
            known = np.bincount(cell, minlength=scores.size).reshape(scores.shape) > 0
            scores = np.where(known, scores, -np.inf)
            if width > limit:
                known &= scores >= np.partition(scores, width - limit, axis=1)[:, width - limit, None]
            qi, ci = np.nonzero(known)
            order = np.lexsort((ci, -scores[qi, ci], qi))
            qi, ci = qi[order], ci[order]
            best = np.arange(len(qi)) - np.searchsorted(qi, qi) < limit
            qi, ci = qi[best], ci[best]
            out["query_id"].append(askers.take(pa.array(q + qi)))
            out["id"].append(ids.take(pa.array(ci)))
            out["document_id"].append(documents.take(pa.array(ci)))
            out["keyword_bm25_score"].append(pa.array(scores[qi, ci]))
            q = end
    return pa.table({name: pa.chunked_array(parts) for name, parts in out.items()})


class TextIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # --- writing ---------------------------------------------------------------

    def change(self, state: IndexState, documents: DataFrame | None, old: DataFrame | None, new: DataFrame | None) -> IndexState:
        """The state after all chunks of ``documents(document_id)`` gave way to ``new``.

        ``old`` and ``new`` are chunks with ``id, document_id, chunk_text``: what the
        documents had, and all that they have now.  Without ``documents`` chunks are only added.
        """
        number, folder = state.next_number, uuid.uuid4().hex[:12]
        buckets, plus, minus = 1, (0, 0), (0, 0)
        if new is not None:
            split = new.select("id", "document_id", "chunk_text", tokens(F.coalesce("chunk_text", F.lit(""))).alias("tokens"))
            size = F.coalesce(F.octet_length("chunk_text"), F.lit(0)).alias("bytes")
            words = [F.array_join("tokens", " ").alias("words"), F.size("tokens").alias("length"), size]
            buckets, plus = self._write_postings(number, folder, split.select("id", "document_id", *words))
        if old is not None:
            minus = self._write_lost(number, folder, old, buckets)
        if documents is not None:
            documents.select("document_id").distinct().write.parquet(self._folder("replaced", number, folder))
        deltas = (*state.deltas, (number, folder, buckets))
        changed = IndexState(deltas, state.chunks + plus[0] - minus[0], state.tokens + plus[1] - minus[1])
        return self.merged(changed) if len(deltas) > MERGE_AFTER else changed

    def _folder(self, kind: str, number: int, folder: str) -> str:
        return f"{self.path}/{kind}/delta={number}-{folder}"

    def _write_lost(self, number: int, folder: str, old: DataFrame, buckets: int) -> tuple[int, int]:
        """How many of the old chunks had each term; their number and tokens."""
        words = old.select(tokens(F.coalesce("chunk_text", F.lit(""))).alias("tokens"))
        # A row without a term for each chunk brings the totals along: no text is split twice (nor for a size
        # filter, which Spark adds to the inner form of the explosion).
        terms = F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("tokens"))).alias("term")
        lost = words.select(F.size("tokens").alias("length"), terms).groupBy("term")
        lost = lost.agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("length"))).alias("tokens"))
        lost = lost.withColumn("bucket", F.when(F.col("term").isNull(), CHUNK_BUCKET).otherwise(_term_bucket(buckets)))
        path = self._folder("gone", number, folder)
        with shuffles_released(self.spark):
            lost.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
        totals = self.spark.read.schema("df long, tokens long, bucket int").parquet(path).where(F.col("bucket") == CHUNK_BUCKET).first()
        return (totals.df, totals.tokens) if totals else (0, 0)

    def _write_postings(self, number: int, folder: str, chunks: DataFrame) -> tuple[int, tuple[int, int]]:
        """Cut ``id, document_id, words, length, bytes`` into blocks; the number of term folders, and the chunks' number and tokens."""
        chunks = chunks.withColumn("class", _length_class(F.col("length")))
        # Lengths have few classes (four for each power of two).  Texts are split once more for them: no table of words is written.
        classes = chunks.groupBy("class").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes")).collect()
        size = sum(c.bytes for c in classes)
        buckets = max(1, min(256, size // (BUCKET_ROWS * POSTING_BYTES)))
        shares = [(c["class"], max(-(-c.chunks // BLOCK), -(-c.bytes // BLOCK_BYTES))) for c in classes]
        shares = F.broadcast(self.spark.createDataFrame(shares, "class int, shares long"))
        block = F.shiftleft(F.col("class").cast("long"), 40) + F.pmod(F.xxhash64("id"), F.col("shares"))
        placed = chunks.join(shares, "class").select("id", "document_id", "words", block.alias("block"))
        packed_row, block_row = _arrow_schema(PACKED_ROW), _arrow_schema(BLOCK_ROW)
        packed = placed.groupBy("block").applyInArrow(lambda rows: _block_rows(rows, buckets, packed_row), PACKED_ROW)
        # Chunks move once, by block; what moves by term are lists of numbers.  A term that most chunks hold
        # is met in several tasks; its blocks stay whole.
        term_parts = TERM_PARTS * max(1, size // (256 * BUCKET_ROWS * POSTING_BYTES))
        part = F.pmod(F.xxhash64("block"), F.when(F.col("bucket") == CHUNK_BUCKET, CHUNK_PARTS).otherwise(term_parts))
        folders = packed.groupBy("bucket", part.alias("part")).applyInArrow(lambda rows: _folder_rows(rows, block_row), BLOCK_ROW)
        path = self._folder("postings", number, folder)
        with shuffles_released(self.spark), unsorted_writes(self.spark):
            folders.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        lengths = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["length"])
        written = self.spark.read.schema(f"chunks array<{CHUNK}>, bucket int").parquet(path).where(F.col("bucket") == CHUNK_BUCKET)
        return buckets, (sum(c.chunks for c in classes), written.agg(F.sum(lengths).alias("t")).first().t or 0)

    def merged(self, state: IndexState) -> IndexState:
        """One delta in place of all, from the postings that still count."""
        rows = self._read("postings", state, None, "term string, block long, postings array<int>")
        if rows is None:
            return IndexState((), state.chunks, state.tokens)
        path = work_path(self.spark, "index-live")
        by_block = lambda some: some.groupBy("delta", "block")
        words = by_block(rows).cogroup(by_block(self._chunks(state))).applyInArrow(_chunk_words, "id string, document_id string, words string")
        with shuffles_released(self.spark):
            size = [F.size(F.split("words", " ")).alias("length"), F.octet_length("words").alias("bytes")]
            words.select("*", *size).write.option("compression", "zstd").parquet(path)
        number, folder = state.next_number, uuid.uuid4().hex[:12]
        buckets, _ = self._write_postings(number, folder, self.spark.read.parquet(path))
        delete(self.spark, path)
        return IndexState(((number, folder, buckets),), state.chunks, state.tokens)

    # --- reading ---------------------------------------------------------------

    def _read(self, kind: str, state: IndexState, terms: list[str] | None, schema: str) -> DataFrame | None:
        """Rows of a kind of all deltas with the ``delta`` number, in one scan of the terms' folders, or None."""
        present = [d for d in state.deltas if _exists(self.spark, self._folder(kind, d[0], d[1]))]
        if not present:
            return None
        paths = [self._folder(kind, number, folder) for number, folder, _ in present]
        read = self.spark.read.option("basePath", f"{self.path}/{kind}")
        rows = read.schema(f"{schema}, delta string, bucket int").parquet(*paths)
        if terms is None:
            rows = rows.where(F.col("bucket") != CHUNK_BUCKET)
        else:
            rows = rows.where(self._in_folders(present, terms) & F.col("term").isin(terms))
        return rows.drop("bucket").withColumn("delta", F.substring_index("delta", "-", 1).cast("int"))

    def _in_folders(self, deltas: list[tuple[int, str, int]], terms: list[str]) -> Column:
        """Which folders may hold the terms; deltas differ in the number of their folders."""
        out = F.lit(False)
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        for buckets in sorted({b for *_, b in deltas}):
            named = sorted({r.b for r in asked.select(_term_bucket(buckets).alias("b")).collect()})
            same = [f"{number}-{folder}" for number, folder, b in deltas if b == buckets]
            out = out | (F.col("delta").isin(same) & F.col("bucket").isin(named))
        return out

    def _chunks(self, state: IndexState, blocks: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """``delta, block, number, id, document_id, length`` of the chunks that still count, of all or some ``blocks(delta, block)``."""
        paths = [self._folder("postings", n, f) for n, f, _ in state.deltas if _exists(self.spark, self._folder("postings", n, f))]
        read = self.spark.read.option("basePath", f"{self.path}/postings")
        lists = read.schema(f"block long, chunks array<{CHUNK}>, delta string, bucket int").parquet(*paths).where(F.col("bucket") == CHUNK_BUCKET)
        lists = lists.withColumn("delta", F.substring_index("delta", "-", 1).cast("int"))
        if blocks is not None:
            lists = lists.join(F.broadcast(blocks) if fits_broadcast(blocks, KEY_ROWS) else blocks, ["delta", "block"], "left_semi")
        chunks = self._live(state, lists.select("delta", "block", F.posexplode("chunks").alias("number", "c")).select("delta", "block", "number", "c.*"))
        return chunks if allowed is None else chunks.join(allowed.select("id"), "id", "left_semi")

    def _live(self, state: IndexState, chunks: DataFrame) -> DataFrame:
        """Chunks of documents that no later delta replaced."""
        dead = None
        for number, folder, _ in state.deltas:
            path = self._folder("replaced", number, folder)
            if number > min(n for n, *_ in state.deltas) and _exists(self.spark, path):
                own = self.spark.read.schema("document_id string").parquet(path).withColumn("since", F.lit(number))
                dead = own if dead is None else dead.unionByName(own)
        if dead is None:
            return chunks
        dead = dead.groupBy("document_id").agg(F.max("since").alias("since"))
        # Ids alone: where the replaced documents are many, both sides are dealt by them once.
        dead = F.broadcast(dead) if fits_broadcast(dead, KEY_ROWS) else dead
        return chunks.join(dead, "document_id", "left").where("since IS NULL OR delta >= since").drop("since")

    def search(self, state: IndexState, queries: DataFrame, limit: int, allowed: DataFrame | None = None) -> DataFrame:
        """``query_id, id, document_id, keyword_bm25_score, rank``: the best chunks of each ``(query_id, query_text)``, ties by id.

        ``allowed(id)`` restricts the hits without changing the corpus statistics.
        """
        return _Search(self, state, queries, limit, allowed).result()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class _Search:
    def __init__(self, index: TextIndex, state: IndexState, queries: DataFrame, limit: int, allowed: DataFrame | None) -> None:
        self.index, self.state, self.limit, self.allowed = index, state, limit, allowed
        self.spark = index.spark
        asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))
        self.asked = self._stored(asked, "asked")
        found = self.asked.select("term").distinct().limit(LITERALS + 1).collect()
        self.terms = [r.term for r in found] if len(found) <= LITERALS else None

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        path = work_path(self.spark, f"index-{name}")
        with shuffles_released(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _of_terms(self, kind: str, schema: str) -> DataFrame | None:
        rows = self.index._read(kind, self.state, self.terms, schema)
        if rows is not None and self.terms is None:
            rows = rows.join(self.asked.select("term").distinct(), "term", "left_semi")
        return rows

    def result(self) -> DataFrame:
        heads = self._of_terms("postings", "term string, block long, n long, most_tf int, least_length int")
        schema = "query_id {}, id string, document_id string, keyword_bm25_score double"
        if heads is None or self.terms == []:
            empty = schema.format(self.asked.schema["query_id"].dataType.simpleString())
            return self.spark.createDataFrame([], empty + ", rank int")
        heads = self._stored(heads, "bounds")
        counts = heads.select("term", F.col("n").alias("df"))
        gone = self._of_terms("gone", "term string, df long")
        if gone is not None:
            counts = counts.unionByName(gone.select("term", (-F.col("df")).alias("df")))
        counts = counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        self.weighted = self._stored(self.asked.join(counts, "term"), "terms")
        self.few_terms = fits_broadcast(self.weighted)

        met = lookup_join(heads, self.weighted, ["term"], small=self.few_terms)
        bound = self._part(F.col("most_tf"), F.col("least_length"))
        bounds = self._stored(met.groupBy("query_id", "delta", "block").agg(F.sum(bound).alias("bound")), "block-bounds")
        order = [F.col("bound").desc(), F.col("delta"), F.col("block")]
        first = self._stored(top_per_group(bounds, ["query_id"], order, FIRST_BLOCKS).drop("rank"), "first")
        scored = self._stored(self._scored(first), "scored")
        kth = top_per_group(scored, ["query_id"], self._best(), self.limit).groupBy("query_id")
        kth = kth.agg(F.count("*").alias("n"), F.min("keyword_bm25_score").alias("least")).where(F.col("n") == self.limit)
        rest = bounds.join(first.select("query_id", "delta", "block"), ["query_id", "delta", "block"], "left_anti")
        # Bounds are sums in no fixed order: a block within rounding of the k-th score is read.
        rest = rest.join(F.broadcast(kth) if fits_broadcast(kth) else kth, "query_id", "left")
        rest = self._stored(rest.where("least IS NULL OR bound >= least - 1e-6").select("query_id", "delta", "block"), "rest")
        self.blocks_read = (first.count(), rest.count(), bounds.count())
        both = scored.unionByName(self._scored(rest)) if self.blocks_read[1] else scored
        return top_per_group(both, ["query_id"], self._best(), self.limit)

    def _best(self) -> list[Column]:
        return [F.col("keyword_bm25_score").desc(), F.col("id")]

    def _part(self, tf: Column, length: Column) -> Column:
        return bm25(tf, length, F.lit(self.state.chunks), F.col("df"), F.lit(self._average()))

    def _average(self) -> float:
        return self.state.tokens / max(self.state.chunks, 1)

    def _scored(self, blocks: DataFrame) -> DataFrame:
        """The best scores of each query in each of its ``blocks(query_id, delta, block)``, from their postings alone."""
        rows = self._of_terms("postings", "term string, block long, postings array<int>")
        askers = blocks.groupBy("delta", "block").agg(F.collect_set("query_id").alias("askers"))
        keys = blocks.select("delta", "block").distinct()
        named = keys.limit(LITERALS + 1).collect()
        if len(named) <= LITERALS:
            rows = rows.where(F.col("delta").isin(sorted({r.delta for r in named})) & F.col("block").isin(sorted({r.block for r in named})))
        rows = rows.join(F.broadcast(keys) if fits_broadcast(keys, KEY_ROWS) else keys, ["delta", "block"], "left_semi")
        terms = self.weighted.groupBy("term").agg(F.first("df").alias("df"), F.collect_list("query_id").alias("queries"))
        rows = lookup_join(rows, terms, ["term"], small=self.few_terms).select("delta", "block", "df", "queries", "postings")
        # A chunk's block is the same for all its terms: a block's scores are added up in one task, and only the best go on.
        chunks = self.index._chunks(self.state, keys, self.allowed)
        chunks = chunks.groupBy("delta", "block").agg(F.collect_list(F.struct("number", "id", "document_id", "length")).alias("chunks"))
        chunks = chunks.join(askers, ["delta", "block"])
        kind = self.asked.schema["query_id"].dataType.simpleString()
        total, average, limit = self.state.chunks, self._average(), self.limit
        of_block = lambda some: some.groupBy("delta", "block")
        scored = of_block(rows).cogroup(of_block(chunks)).applyInArrow(
            lambda postings, listed: _block_scores(postings, listed, total, average, limit),
            f"query_id {kind}, id string, document_id string, keyword_bm25_score double",
        )
        return scored.withColumn("keyword_bm25_score", F.round("keyword_bm25_score", SCORE_DIGITS))
