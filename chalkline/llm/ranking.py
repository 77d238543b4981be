"""Ranked lexical search over an index of document ranges, by best-first branch and bound.

Terms are runs of A-Z, a-z, 0-9 and characters beyond ASCII, A-Z lower-cased. write_index() reads documents once, in ranges
of SHARD_BYTES or SHARD_ROWS: a range's row has its own vocabulary and, document by document, its terms and how often each
occurs. It serves any queries. A search takes queries in blocks of BLOCK_BYTES and makes two passes over the index for
each: the statistics of the block's terms, then a tree for each range, whose nodes hold each term's greatest share of a
score among their documents (a document's share is 1000000000*tf div (1000*tf + 8*m)). A node's bound for a query is the
sum of these by the terms' weights. The first pass gives the bounds of whole ranges; each query's most promising range
is searched first, and its tenth score is where the search of all other ranges whose bound reaches it begins. Inside a
range nodes are opened by bound, highest first, until none reaches the tenth score; nodes of an equal bound are opened too,
as they may hold ties. Ranges are separate tasks and nothing of them but the best of each query is shuffled.

Null texts have no terms; documents and queries without any match nothing; repeated rows are ranked each; equal scores go by
ascending doc_id, null first; queries are told apart by their place, so an item_id may have several texts; empty tables give
no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.llm.common import Shared, bounded_batches, checkpointed, gathered, id_and_text, maybe_broadcast, shared_path

#: Bytes of texts and documents of a range; bytes of queries searched at once; children of a node.
SHARD_BYTES, SHARD_ROWS, BLOCK_BYTES, FAN = 4 << 20, 4096, 8 << 20, 16
#: Bytes of a row group of the index's files. Spark reads a whole group at once, so without the checks after every row (Parquet
#: waits for 100, hundreds of MB of ranges) a reader's memory grows with the ranges of a file.
GROUP_BYTES = 4 << 20
WRITING = {"compression": "zstd", "parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
TOP = 10
INDEX = "shard long, doc_ids array<long>, sizes array<long>, terms array<binary>, frequencies array<int>, offsets array<int>, numbers array<int>, counts array<int>"
COLUMNS = ["shard", "doc_ids", "sizes", "terms", "offsets", "numbers", "counts"]
#: Stands for a missing id among numbers; it sorts first, as null does.
NO_ID = np.iinfo(np.int64).min

_KIND = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256))
_LETTERS = np.frombuffer(_KIND, np.uint8)


def _terms(column):
    """Terms of a batch's texts (binary column) one after another as a pyarrow binary array, and how many each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = pc.binary_length(column).fill_null(0).to_numpy().astype(np.int64)
    data = np.frombuffer(b"\0".join(x or b"" for x in column.to_pylist()) + b"\0", np.uint8)
    data = _LETTERS[data]
    word = data != 0
    starts = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    sizes = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1 - starts
    ends = np.cumsum(lengths + 1)
    number = np.diff(np.r_[0, np.searchsorted(starts, ends)]) if len(ends) else ends
    cuts = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(data[word].tobytes())]), number


def _index_batches(batches):
    import pyarrow as pa

    task, count = TaskContext.get().partitionId(), 0
    for batch in gathered(batches, 1, SHARD_BYTES):
        for k in range(0, batch.num_rows, SHARD_ROWS):
            part = batch.slice(k, SHARD_ROWS)
            words, sizes = _terms(part.column(1).cast(pa.binary()))
            coded = words.dictionary_encode()
            known = len(coded.dictionary)
            pairs, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, known) + coded.indices.to_numpy(), return_counts=True)
            docs, numbers = pairs // max(1, known), pairs % max(1, known)
            offsets = np.searchsorted(docs, np.arange(len(sizes) + 1))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            ids, ints = part.column(0), lambda x: pa.array(x.astype(np.int32))
            columns = [pa.array([(task << 33) + count], pa.int64()), one(ids), one(pa.array(sizes.astype(np.int64))), one(coded.dictionary), *map(one, map(ints, (np.bincount(numbers, minlength=known), offsets, numbers, counts)))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_ids", "sizes", "terms", "frequencies", "offsets", "numbers", "counts"])
            count += 1


def write_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the index of all of docs (doc_id, text) to Parquet at path; gives it, read back."""
    spark = docs.sparkSession
    bounded_batches(spark)
    id_and_text(docs).mapInArrow(_index_batches, INDEX).write.options(**WRITING).parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Queries:
    """Queries of a block: item_ids by place, terms with their weights, each query's terms and how often it has them."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]]):
        self.item_ids = [item for item, _ in rows]
        counted = [Counter((text or b"").translate(_KIND.replace(b"\0", b" ")).split()) for _, text in rows]
        self.terms = sorted({t for c in counted for t in c})
        at = {t: i for i, t in enumerate(self.terms)}
        self.of = [(np.array([at[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counted]
        self.weights = np.zeros(len(self.terms), np.int64)
        self.documents = self.total = 0

    def weigh(self, frequencies: dict[bytes, int], documents: int, total: int) -> None:
        self.documents, self.total = documents, total
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * frequencies.get(t, 0) + 1))) for t in self.terms], np.int64)


class Range:
    """The tree over a range's documents for the terms of a block of queries: of each level, terms x nodes of greatest shares."""

    def __init__(self, row: dict, queries: Queries):
        import pyarrow as pa
        import pyarrow.compute as pc

        self.queries = queries
        found = pc.index_in(row["terms"], value_set=pa.array(queries.terms, pa.binary()))
        local = np.asarray(found.fill_null(-1))
        self.terms, offsets = np.unique(local[local >= 0]), row["offsets"]
        compact = np.full(len(queries.terms) + 1, -1, np.int64)
        compact[self.terms] = np.arange(len(self.terms))
        numbers = compact[local][row["numbers"]] if len(local) else row["numbers"].astype(np.int64)
        keep = numbers >= 0
        docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
        counts = row["counts"][keep].astype(np.int64)
        sizes, at = np.unique(row["sizes"], return_inverse=True)
        m = np.array([25 + 75 * int(n) * queries.documents // max(1, queries.total) for n in sizes], np.int64)[at]
        # postings in order of documents; what document and term add to a score by weight 1
        self.numbers, self.doc_ids = numbers[keep], row["doc_ids"]
        self.shares = 1_000_000_000 * counts // (1000 * counts + 8 * m[docs])
        self.starts = np.searchsorted(docs, np.arange(len(offsets)))
        self.levels, width = [], len(self.doc_ids)
        node, shares, numbers = docs, self.shares, self.numbers
        while width > 1 or not self.levels:
            node, width = node // FAN, -(-width // FAN)
            key = numbers * width + node
            order = np.argsort(key, kind="stable")
            firsts = np.flatnonzero(np.diff(key[order], prepend=-1))
            shares = np.maximum.reduceat(shares[order], firsts) if len(firsts) else shares
            key = key[order][firsts]
            numbers, node = key // max(1, width), key % max(1, width)
            level = np.zeros((len(self.terms), width), np.int64)
            level[numbers, node] = shares
            self.levels.append(level)
        self.at = compact

    def weights_of(self, query: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a query that the range has, and their weights times how often the query has them."""
        terms, times = self.queries.of[query]
        local = self.at[terms]
        here = (local >= 0) & (self.queries.weights[terms] > 0)
        return local[here], (self.queries.weights[terms] * times)[here]

    def bound(self, query: int) -> int:
        terms, weights = self.weights_of(query)
        return int(weights @ self.levels[-1][terms, 0])

    def search(self, query: int, least: int, top: int) -> list[tuple[int, int]]:
        """(score, doc_id) of the range's best documents whose score is at least least, ties and all."""
        terms, weights = self.weights_of(query)
        every = np.zeros(len(self.terms), np.int64)
        every[terms] = weights
        best: list[int] = []  # a heap of the top scores
        found, nodes = [], [(-self.bound(query), len(self.levels) - 1, 0)]
        while nodes:
            bound, level, node = heapq.heappop(nodes)
            if -bound < least:
                break
            first = node * FAN
            if level:
                bounds = weights @ self.levels[level - 1][terms, first : first + FAN]
                for child in np.flatnonzero(bounds >= max(1, least)).tolist():
                    heapq.heappush(nodes, (-int(bounds[child]), level - 1, first + child))
                continue
            cuts = self.starts[first : first + FAN + 1]
            part = slice(cuts[0], cuts[-1])
            upto = np.r_[0, np.cumsum(every[self.numbers[part]] * self.shares[part])]
            scores = np.diff(upto[cuts - cuts[0]])
            for child in np.flatnonzero(scores >= max(1, least)).tolist():
                score = int(scores[child])
                found.append((score, first + child))
                (heapq.heappush if len(best) < top else heapq.heappushpop)(best, score)
                if len(best) == top:
                    least = max(least, best[0])
        ranked = sorted((-score, int(self.doc_ids[doc])) for score, doc in found if score >= least)
        return [(-score, doc) for score, doc in ranked[:top]]


def _ranges(batches, queries: Queries):
    """(shard, tree) of each row of the index."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n).slice(i, 1).flatten() for n in COLUMNS[1:]}
            row["doc_ids"] = row["doc_ids"].fill_null(NO_ID)
            yield batch.column("shard")[i].as_py(), Range({n: v if n == "terms" else v.to_numpy(zero_copy_only=False) for n, v in row.items()}, queries)


def _best_ranges(queries):
    """Of a task's ranges, each query's with the greatest bound."""

    def run(batches):
        import pyarrow as pa

        best, where = np.zeros(len(queries.value.of), np.int64), np.zeros(len(queries.value.of), np.int64)
        for shard, tree in _ranges(batches, queries.value):
            bounds = np.array([tree.bound(q) for q in range(len(best))], np.int64)
            where, best = np.where(bounds > best, shard, where), np.maximum(bounds, best)
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(best[some]), pa.array(where[some])], ["query", "bound", "shard"])

    return run


def _search(queries, top: int, seeds: dict[int, int], least: dict[int, int] | None):
    """Best documents of the seeds' ranges alone (least is None), or of all other ranges whose bound reaches the query's least."""

    def run(batches):
        import pyarrow as pa

        for shard, tree in _ranges(batches, queries.value):
            rows = []
            for q, seed in seeds.items():
                if (shard == seed) == (least is None):
                    start = 1 if least is None else least.get(q, 1)
                    rows += [(q, score, doc) for score, doc in tree.search(q, start, top)]
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["query", "score", "doc_id"])

    return run


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The top rows of each query; first by parts of its rows, so no task gets all."""
    order = [F.desc("score"), F.asc("doc_id")]
    parts = rows.withColumn("part", F.spark_partition_id() % 64)
    for key in (["query", "part"], ["query"]):
        parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= top)
    return parts.select("query", "rank", "score", "doc_id")


def _search_block(index: DataFrame, queries: Queries, statistics: tuple[int, int], top: int) -> DataFrame:
    """query (its place in the block), rank, score, doc_id."""
    spark = index.sparkSession
    terms = spark.createDataFrame([(t,) for t in queries.terms], "term binary")
    each = index.select(F.explode(F.arrays_zip("terms", "frequencies")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.frequencies").alias("n"))
    counted = each.join(maybe_broadcast(terms, len(queries.terms)), "term").groupBy("term").agg(F.sum("n").alias("n"))
    queries.weigh({bytes(t): n for t, n in counted.collect()}, *statistics)
    shared = Shared(spark, queries)  # BLOCK_BYTES of texts at most, or one query
    index = index.select(*COLUMNS)
    bounds = index.mapInArrow(_best_ranges(shared), "query int, bound long, shard long")
    seeds = dict(tuple(r) for r in bounds.groupBy("query").agg(F.max(F.struct("bound", "shard")).alias("m")).select("query", "m.shard").collect())
    found = "query int, score long, doc_id long"
    opened = index.where(F.col("shard").isin(sorted(set(seeds.values()))))
    first = checkpointed(_best(opened.mapInArrow(_search(shared, top, seeds, None), found), top))
    least = dict(tuple(r) for r in first.where(F.col("rank") == top).select("query", "score").collect())
    others = _best(index.mapInArrow(_search(shared, top, seeds, least), found), top)
    return checkpointed(_best(first.union(others).select("query", "score", "doc_id"), top))


def search(index: DataFrame, items: DataFrame, top: int = TOP, size: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the top documents of the index for each row of items (item_id, text)."""
    spark = index.sparkSession
    bounded_batches(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    n = F.aggregate(F.transform("sizes", lambda x: F.struct(x.alias("n"))), F.struct(F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("terms")), lambda a, x: F.struct((a["docs"] + (x["n"] > 0).cast("long")).alias("docs"), (a["terms"] + x["n"]).alias("terms")))
    statistics = tuple(x or 0 for x in index.select(n.alias("s")).agg(F.sum("s.docs"), F.sum("s.terms")).first())
    texts = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text"))
    blocks = max(1, math.ceil((texts.agg(F.sum(F.length("text"))).first()[0] or 0) / size))
    found = None
    for k in range(blocks):
        rows = (texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else texts).collect()
        queries = Queries([(r[0], None if r[1] is None else bytes(r[1])) for r in rows])
        if not queries.terms:
            continue
        names = spark.createDataFrame(list(enumerate(queries.item_ids)), f"query int, item_id {kind}")
        own = _search_block(index, queries, statistics, top).join(maybe_broadcast(names, len(rows)), "query")
        own = own.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        found = own if found is None else found.union(own)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found


def ranked_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index docs in the shared folder, then search for items."""
    return search(write_index(docs, shared_path(spark, "index")), items, top)
