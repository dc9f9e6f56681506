"""Benchmark decontamination by counted spaced seeds, in DataFrame expressions only.

Words (lower-cased runs of letters and digits) are hashed once.  A *mask* picks some
places of a short run and ignores the others; at every position the words that a mask
picks are hashed together as a spaced seed.  An equi-join of these seeds between
documents and benchmark items counts the seeds that agree on each alignment (document,
item, shift).  A substituted word spoils one seed for each place of each mask at most,
so an alignment that satisfies the rule keeps :meth:`DecontamRules.sure_seeds` of them
whatever words are substituted; those with as many are verified on the words
themselves: somewhere on the alignment, a window of ``window`` words (the whole item,
if shorter) must agree in ``percent`` of its words, or in all of them if the item has
fewer than ``whole_below`` words.

A null or empty text has no words; one of any length is hashed whole.  Items with
fewer than ``least_words`` words are no evidence and are ignored, as are null ones
(:func:`items_without_evidence` lists them); items with equal words count as one, under
the smallest id.  Documents are verified row by row, so rows that repeat an id do no
harm, and neither do rows without one: they are reported under a null ``doc_id``, or
left out by :func:`clean_documents`, like any other.  No documents, or no items, give
no overlaps.  Other columns of ``docs`` are ignored, or kept by
:func:`clean_documents`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.binding import let
from lodestone.session import work_path


@dataclass(frozen=True)
class DecontamRules:
    masks: tuple[tuple[int, ...], ...] = ((0, 1, 3), (0, 2, 3))  # places hashed together, of one span
    window: int = 20  # words that have to be aligned
    percent: int = 80  # of them that have to agree
    whole_below: int = 10  # shorter items have to agree in all words
    least_words: int = 6  # shorter items are no evidence
    broadcast_seeds: int = 1_000_000  # benchmark seeds (16 bytes each) sent whole to every task, at most
    broadcast_found: int = 200_000  # documents, or shares of their alignments, sent whole to every task, at most
    at_once: int = 256  # alignments (item, shift and size) of a document in one row, at most

    def __post_init__(self) -> None:
        unsure = [n for n in range(self.least_words, max(self.window, self.least_words) + 1) if self.sure_seeds(n) < 1]
        if len({max(mask) for mask in self.masks}) != 1 or any(min(mask) for mask in self.masks):
            raise ValueError("all masks begin at 0 and have one span")
        if unsure:
            raise ValueError(f"items of {unsure} words can agree as demanded without a common seed of masks {self.masks}")

    @property
    def span(self) -> int:
        return max(self.masks[0]) + 1

    def agreeing(self, n: int) -> int:
        """Words of a window that have to agree for an item of ``n`` words."""
        width = min(n, self.window)
        return width if n < self.whole_below else -(-self.percent * width // 100)

    def sure_seeds(self, n: int) -> int:
        """Seeds that agree at least on an alignment with an item of ``n`` words that satisfies the rule."""
        width = min(n, self.window)
        spoilt = sum(map(len, self.masks)) * (width - self.agreeing(n))
        return len(self.masks) * (width - self.span + 1) - spoilt

    def of_size(self, size: Column, value: Callable[[int], int]) -> Column:
        """``value`` (:meth:`agreeing` or :meth:`sure_seeds`) for a column of item sizes."""
        by_width = F.array(*(F.lit(value(n)) for n in range(self.least_words, max(self.window, self.whole_below, self.least_words) + 1)))
        return F.element_at(by_width, F.least(size - (self.least_words - 1), F.size(by_width)))


def word_hashes(text: Column) -> Column:
    """A hash for each word of a text."""
    found = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def seed_hashes(hashes: Column, rules: DecontamRules) -> Column:
    """The seeds of the masks in turn, each at all positions; null where there are fewer words than the span."""

    def of(h: Column) -> Column:
        picked = lambda k, p: [F.get(h, p + F.lit(i)) for i in rules.masks[k]]
        places = F.sequence(F.lit(0), F.size(h) - rules.span)
        of_mask = lambda k: F.transform(places, lambda p: F.xxhash64(F.lit(k), *picked(k, p)))
        return F.concat(*map(of_mask, range(len(rules.masks))))

    return F.when(F.size(hashes) >= rules.span, let(hashes, of))


def _positions(rows: DataFrame, rules: DecontamRules, *keys: str) -> DataFrame:
    """``keys, position, seed`` for every seed of ``rows(keys, hashes)``."""
    places = F.size("hashes") - (rules.span - 1)
    listed = rows.select(*keys, places.alias("places"), F.posexplode_outer(seed_hashes(F.col("hashes"), rules)).alias("at", "seed"))
    return listed.select(*keys, F.when(F.col("places") > 0, F.try_mod("at", "places")).alias("position"), "seed")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item, words``: each distinct word sequence under its smallest ``item_id``."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("words"))
    return items.groupBy("words").agg(F.min("item_id").alias("item"))


def items_without_evidence(benchmark: DataFrame, rules: DecontamRules = DecontamRules()) -> DataFrame:
    """``item_id, n_words`` of the items that no document is compared with, since they have too few words."""
    n_words = F.coalesce(F.size(word_hashes(F.col("text"))), F.lit(0)).cast("long")
    return benchmark.select("item_id", n_words.alias("n_words")).where(F.col("n_words") < rules.least_words)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with one id are told apart by their texts, which also spreads rows without id."""
    return docs.select("text", F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))


def _with_key(keyed: DataFrame, few: DataFrame, rules: DecontamRules, how: str) -> DataFrame:
    """``keyed`` joined by (_doc, _text) with a stored table, which is sent to its rows if it is small."""
    same = keyed["_doc"].eqNullSafe(few["_doc"]) & (keyed["_text"] == few["_text"])
    return keyed.join(F.broadcast(few) if few.count() <= rules.broadcast_found else few, same, how)


def alignments(docs: DataFrame, items: DataFrame, rules: DecontamRules) -> DataFrame:
    """``_doc, _text, item, shift, size``: where a document's words may repeat an item's ``size`` words.

    Only those with as many common seeds as the rule behind them makes sure of
    (repeated rows add to the count, never the reverse).  Benchmark seeds are stored
    and counted first.  Within ``broadcast_seeds`` they are sent to the documents;
    more of them are joined by shuffling both sides.  Hits are counted by alignment,
    and combined before they are shuffled.
    """
    evidence = items.select("item", F.size("words").alias("size"), F.col("words").alias("hashes"))
    known = _positions(evidence.where(F.col("size") >= rules.least_words), rules, "item", "size")
    known = _stored(known.withColumnRenamed("position", "item_position"), "benchmark-seeds")
    texts = _keyed(docs).select("_doc", "_text", word_hashes(F.col("text")).alias("hashes"))
    seeds = _positions(texts, rules, "_doc", "_text")
    small = known.count() <= rules.broadcast_seeds
    hits = seeds.join(F.broadcast(known) if small else known, "seed")
    shift = (F.col("position") - F.col("item_position")).alias("shift")
    counted = hits.groupBy("_doc", "_text", "item", "size", shift).agg(F.count("*").alias("common"))
    return counted.where(F.col("common") >= rules.of_size(F.col("size"), rules.sure_seeds)).drop("common")


def shares(proposed: DataFrame, rules: DecontamRules) -> DataFrame:
    """``_doc, _text, proposed``: the alignments of a document, ``at_once`` in a row at most."""
    place = F.row_number().over(Window.partitionBy("_doc", "_text").orderBy("item", "shift"))
    numbered = proposed.withColumn("share", F.floor((place - 1) / rules.at_once))
    gathered = numbered.groupBy("_doc", "_text", "share").agg(F.collect_list(F.struct("item", "shift", "size")).alias("proposed"))
    return gathered.drop("share")


def _most_agreeing(words: Column, item: Column, shift: Column, rules: DecontamRules) -> Column:
    """Most words that agree in a window on the alignment, or -1 where no whole window fits."""
    width = F.least(F.size(item), F.lit(rules.window))
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(words) - shift) - width
    agrees = F.transform(item, lambda w, i: F.when(F.get(words, i + shift) == w, 1).otherwise(0))
    window = lambda same: F.array_max(
        F.transform(
            F.sequence(first, last),
            lambda s: F.aggregate(F.slice(same, s + 1, width), F.lit(0), lambda total, one: total + one),
        )
    )
    return F.when(last >= first, let(agrees, window)).otherwise(-1)


def _verified(docs: DataFrame, items: DataFrame, rules: DecontamRules) -> DataFrame:
    """``_doc, _text, overlaps``: the alignments of documents that satisfy the rule, each checked in a row of its own.

    A row takes along the words below the item only.
    """
    keyed = _keyed(docs)
    gathered = _stored(shares(alignments(docs, items, rules), rules), "benchmark-alignments")
    met = _with_key(keyed, gathered, rules, "inner").select(
        keyed["_doc"], keyed["_text"], word_hashes(F.col("text")).alias("words"), "proposed"
    )
    rows = met.select("_doc", "_text", "words", F.explode_outer("proposed").alias("p")).select("_doc", "_text", "words", "p.*")
    outside = F.least(F.col("shift"), F.lit(0))  # less than 0 where the item starts before the document
    below = F.slice("words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("size") + outside)
    rows = rows.select("_doc", "_text", "item", "shift", "size", below.alias("below")).join(items, "item")
    matched = _most_agreeing(F.col("below"), F.col("words"), outside, rules).alias("matched")
    checked = rows.select("_doc", "_text", "item", matched, "shift", "size")
    good = checked.where(F.col("matched") >= rules.of_size(F.col("size"), rules.agreeing))
    overlap = F.struct("item", "matched", "shift")
    return good.groupBy("_doc", "_text").agg(F.array_sort(F.collect_set(overlap)).alias("overlaps"))


def _with_overlaps(docs: DataFrame, benchmark: DataFrame, rules: DecontamRules) -> DataFrame:
    """``row, overlaps``: every row of ``docs`` as one value, so that its columns may have any names."""
    items = _stored(benchmark_items(benchmark), "benchmark-items")
    found = _stored(_verified(docs, items, rules), "benchmark-overlaps")
    keyed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    return _with_key(keyed, found, rules, "left").select(keyed["row"], found["overlaps"])


def overlaps(docs: DataFrame, benchmark: DataFrame, rules: DecontamRules = DecontamRules()) -> DataFrame:
    """``docs`` with ``overlaps``: the verified (item, matched, shift), smallest item first, or null.

    Documents are shuffled only where more than ``broadcast_found`` of them have
    alignments, and only verified alignments meet in a document's row.  A column of
    ``docs`` that is called ``overlaps`` itself gives way.
    """
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "overlaps"]
    return _with_overlaps(docs, benchmark, rules).select(*kept, "overlaps")


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: DecontamRules = DecontamRules()) -> DataFrame:
    """One row per document that repeats a benchmark item, with the items and the best match."""
    found = overlaps(docs.select("doc_id", "text"), benchmark, rules).where("overlaps IS NOT NULL")
    item_ids = F.array_sort(F.array_distinct(F.transform("overlaps", lambda o: o["item"])))
    return found.select(
        "doc_id",
        F.lit(True).alias("contaminated"),
        F.size(item_ids).cast("long").alias("n_items"),
        item_ids.alias("item_ids"),
        F.array_max(F.transform("overlaps", lambda o: o["matched"])).cast("long").alias("matched_words"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, rules: DecontamRules = DecontamRules()) -> DataFrame:
    """The documents without a verified overlap, with all their columns."""
    return _with_overlaps(docs, benchmark, rules).where("overlaps IS NULL").select("row.*")
