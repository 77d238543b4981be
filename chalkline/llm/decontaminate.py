"""Benchmark decontamination by suffix arrays of the documents.

Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased. Documents of SHARD_BYTES are one shard: their
words are numbered by the benchmark's vocabulary, any other word or a document's end being 0, and the suffixes that
begin with enough known words are sorted. Every suffix of every benchmark row is looked up in each shard by binary
search; neighbouring finds on one diagonal join to the longest verbatim matches, kept with their places.

A match has WINDOW words at least, or is a whole item of fewer words. Benchmark rows are told apart by their place, so
an item_id may have several texts; rows without an item_id are searched for, but aren't counted as items. The benchmark
is read in blocks of BLOCK_BYTES. One block is the rule: documents then are never shuffled and each keeps its row. Of
several, one after another is broadcast for a pass of its own, whose matches alone are kept, by doc_id and the text's
hash; so memory doesn't grow with the benchmark. Null and empty texts have no words and no matches; items without words
match nothing; an empty benchmark leaves all documents clean; repeated rows get equal results; other columns are left
out by the search and kept by the filter.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import bounded_batches, checkpointed, filtered, fresh, gathered, id_and_text, maybe_broadcast

WINDOW = 13
#: Bytes of benchmark texts that are searched for in one pass; of documents' texts whose suffixes are sorted at once.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 4 << 20
#: A document is contaminated if matches cover at least one word of so many.
SHARE = 20
MATCHES = "array<struct<item_id:bigint,item_start:int,doc_start:int,length:int>>"
#: Stands for a missing item_id among numbers; it sorts first, as null does.
NO_ITEM = np.iinfo(np.int64).min

WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(WORD_BYTES).split()


class BenchmarkIndex:
    """Vocabulary of the items and, for each of their suffixes that is to be found, its first words as a search key."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        self.window = window
        texts = [(item, w) for item, text in items if (w := words_of(text))]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, words in texts for w in words}))}
        self.kind = ">u2" if len(self.vocabulary) < 1 << 16 else ">u4"
        self.item_ids = np.array([NO_ITEM if item is None else item for item, _ in texts], np.int64)
        keys, rows, starts, lengths = [np.empty((0, window), self.kind)], [], [], []
        for row, (_, words) in enumerate(texts):
            numbers = np.array([self.vocabulary[w] for w in words], self.kind)
            n = min(len(numbers), window)
            padded = np.concatenate([numbers, np.zeros(window - n, self.kind)])
            keys.append(np.lib.stride_tricks.sliding_window_view(padded, window))
            rows.append(np.full(len(keys[-1]), row, np.int32))
            starts.append(np.arange(len(keys[-1]), dtype=np.int32))
            lengths.append(np.full(len(keys[-1]), n, np.int32))
        self.row, self.start, self.length = (np.concatenate([np.empty(0, np.int32), *x]) for x in (rows, starts, lengths))
        self.least = int(self.length.min()) if len(self.length) else window
        self.numbers = np.concatenate(keys)
        self.bounds: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"bounds": None}

    def packed(self, rows: np.ndarray) -> np.ndarray:
        """Rows of numbers as byte strings that sort alike."""
        rows = np.ascontiguousarray(rows.astype(self.kind))
        return rows.view(f"S{rows.dtype.itemsize * self.window}").ravel() if len(rows) else np.empty(0, f"S{rows.dtype.itemsize * self.window}")

    def search(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """How many words each text has; of all longest matches the text, the benchmark row, place in the row, place in the text, length."""
        get, numbers, sizes = self.vocabulary.get, [], []
        for text in texts:
            words = words_of(text)
            numbers.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            numbers.append(np.zeros(1, np.int32))
            sizes.append(len(words))
        sizes = np.array(sizes, np.int64)
        none = [np.empty(0, np.int64)] * 5
        if not len(self.numbers) or not sizes.sum():
            return sizes, none
        ids = np.concatenate([*numbers, np.zeros(self.window, np.int32)])
        # known words in a row from each place on
        stops = np.flatnonzero(ids == 0)
        run = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids))
        suffixes = np.flatnonzero(run >= self.least)
        if not len(suffixes):
            return sizes, none
        if self.bounds is None:
            whole = np.where(np.arange(self.window) < self.length[:, None], self.numbers, np.iinfo(self.kind).max)
            self.bounds = self.packed(self.numbers), self.packed(whole)
        offsets = np.arange(self.window)
        keys = self.packed(np.where(offsets < run[suffixes, None], ids[np.minimum(suffixes[:, None] + offsets, len(ids) - 1)], 0))
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], suffixes[order]
        low, high = np.searchsorted(keys, self.bounds[0], "left"), np.searchsorted(keys, self.bounds[1], "right")
        found = high - low
        which = np.repeat(np.arange(len(found)), found)
        place = suffixes[np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)]
        row, start, length = (x[which].astype(np.int64) for x in (self.row, self.start, self.length))
        # finds one after another on a diagonal of a row are one match; all windows of a row are equally long
        diagonal = place - start
        order = np.lexsort((place, diagonal, row))
        row, start, length, place, diagonal = (x[order] for x in (row, start, length, place, diagonal))
        first = np.r_[True, (row[1:] != row[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)][: len(row)]
        at = np.flatnonzero(first)
        length = length[at] + np.diff(np.r_[at, len(row)]) - 1
        ends = np.cumsum(sizes + 1) - sizes - 1
        text = np.searchsorted(ends, place[at], "right") - 1
        return sizes, [text, row[at], start[at], place[at] - ends[text], length]


def _covered(sizes: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Words of each text that matches cover."""
    bounds = np.cumsum(sizes + 1) - sizes - 1
    steps = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    np.add.at(steps, bounds[text] + start, 1)
    np.add.at(steps, bounds[text] + start + length, -1)
    return np.add.reduceat((np.cumsum(steps) > 0).astype(np.int64), bounds) if len(sizes) else sizes


def _search_batches(index, sparse: bool):
    """index: a broadcast BenchmarkIndex; sparse: only rows with matches, without their counts."""

    def run(batches):
        import pyarrow as pa

        fields = [pa.field("item_id", pa.int64()), pa.field("item_start", pa.int32()), pa.field("doc_start", pa.int32()), pa.field("length", pa.int32())]
        for batch in gathered(batches, 1, SHARD_BYTES):
            sizes, (text, row, *places) = index.value.search(batch.column(1).to_pylist())
            items = index.value.item_ids[row] if len(row) else row
            # benchmark rows that repeat give a match once
            columns = np.unique(np.stack([text, items, *places], 1), axis=0)
            text, items, *places = columns.T
            hit = _covered(sizes, text, places[1], places[2])
            found = np.bincount(text, minlength=len(sizes))
            values = [pa.array(items, pa.int64(), mask=items == NO_ITEM), *(pa.array(c, f.type) for c, f in zip(places, fields[1:]))]
            matches = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(found)].astype(np.int32)), pa.StructArray.from_arrays(values, fields=fields))
            out = [batch.column(0), batch.column(2), matches, pa.array(sizes), pa.array(hit)]
            out = pa.RecordBatch.from_arrays(out, ["doc_id", "text_key", "matches", "n_words", "n_hit"])
            yield out.filter(pa.array(found > 0)).select([0, 1, 2]) if sparse else out.select([0, 2, 3, 4])

    return run


def _count_batches(batches):
    import pyarrow as pa

    for batch in batches:
        sizes = [len(words_of(x)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64())], ["doc_id", "text_key", "n_words"])


def benchmark_blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> tuple[int, object]:
    """How many blocks the benchmark (item_id, text) has, and what broadcasts the index of one of them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / size))

    def block(k: int):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        return benchmark.sparkSession.sparkContext.broadcast(BenchmarkIndex([(r[0], None if r[1] is None else bytes(r[1])) for r in rows.collect()]))

    return blocks, block


def find_matches(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, matches (sorted), n_words, n_hit for every row of docs (doc_id, text); benchmark: item_id, text."""
    bounded_batches(docs.sparkSession)
    blocks, block = benchmark_blocks(benchmark, size)
    texts = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    if blocks == 1:
        return texts.mapInArrow(_search_batches(block(0), False), f"doc_id long, matches {MATCHES}, n_words long, n_hit long")
    found = None
    for k in range(blocks):
        index = block(k)
        own = checkpointed(texts.mapInArrow(_search_batches(index, True), f"doc_id long, text_key long, matches {MATCHES}").dropDuplicates(["doc_id", "text_key"]))
        index.unpersist()
        found = own if found is None else found.union(own)
    # a row for each block at most; equal texts have equal matches
    merged = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches")).toDF("_id", "_key", "matches")
    counted = texts.mapInArrow(_count_batches, "doc_id long, text_key long, n_words long")
    joined = counted.join(merged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    joined = joined.withColumn("matches", F.coalesce("matches", F.array().cast(MATCHES)))
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_start"].cast("long").alias("a"), (m["doc_start"] + m["length"]).cast("long").alias("b"))))
    state = lambda end, total: F.struct(end.cast("long").alias("end"), total.cast("long").alias("total"))
    covered = F.aggregate(spans, state(F.lit(0), F.lit(0)), lambda acc, s: state(F.greatest(acc["end"], s["b"]), acc["total"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))))
    return joined.select("doc_id", "matches", "n_words", covered["total"].alias("n_hit"))


def _is_contaminated():
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"].cast("string")), lambda x: x.isNotNull())))
    found = find_matches(docs, benchmark, size).withColumn("items", items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        _is_contaminated().alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """Rows of docs but the contaminated ones, all columns kept; of rows that share a doc_id each is judged by its own text."""
    bounded_batches(docs.sparkSession)
    blocks, block = benchmark_blocks(benchmark, size)
    if blocks > 1:
        hashed = docs.select("text").where("text is not null").distinct().select(F.xxhash64(F.col("text").cast("string").cast("binary")).alias("doc_id"), "text")
        bad = checkpointed(find_matches(hashed, benchmark, size).where(_is_contaminated()).select("doc_id").distinct())
        key = fresh(docs, "_bad_text")
        return docs.join(maybe_broadcast(bad.toDF(key), bad.count()), F.xxhash64(docs["text"].cast("string").cast("binary")) == F.col(key), "left_anti")
    index = block(0)

    def clean(texts: list[bytes | None]) -> list[bool]:
        sizes, (text, _, _, start, length) = index.value.search(texts)
        hit = _covered(sizes, text, start, length)
        return (~((hit > 0) & (SHARE * hit >= sizes))).tolist()

    return filtered(docs, clean, SHARD_BYTES)
