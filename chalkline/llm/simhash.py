"""SimHash near-duplicates by a hierarchical index over Gray-ordered fingerprints.

Fingerprints: words are runs of bytes other than ASCII white space, A-Z lower-cased; every 4-word shingle is hashed
with XXH64 (seed 42); a bit is set if it is set in over half the hashes. A shorter text is one shingle; a text without
words, or null, has fingerprint 0 and is linked like any other.

The index: an upper node holds the fingerprints that agree in a mask of bits. With BLOCKS blocks and MAX_BITS allowed
differences, two linked fingerprints agree in BLOCKS - MAX_BITS whole blocks, so the masks of all such choices of
blocks are the first level, and Spark deals fingerprints to its nodes by key. Within a node members are sorted by Gray
rank and split into groups of FAN; a group keeps the bits that all its members share (mask and pattern). Groups of
groups likewise. A pair of groups is pruned as soon as the patterns differ in more than MAX_BITS commonly masked bits,
or if all members of both are linked already. A node gives a spanning forest of its links, never all pairs.

A node of more than NODE_ROWS members gets lower nodes, by masks of further blocks of the bits its own mask leaves
free, and so on: each level copies a member a fixed number of times, whatever the node's size, and a node with few free
bits has few members. Equal fingerprints are one row from the start, however many documents have them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import bounded_batches, checkpointed, drop_ids, fresh, id_and_text, keep_ids, maybe_broadcast, unsigned_hex

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Members of a node that has no lower nodes; free bits of a mask from which nodes are that small anyway.
NODE_ROWS, FEW_FREE = 4096, 12
FAN = 16
PIECE = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"


def word_pieces(data: bytes):
    """Lists of the words of data, piece by piece; a piece ends at white space."""
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[start:end].split()
        start = end


def fingerprint(data: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for words in word_pieces((data or b"").lower()):
        words = carry + words
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = ends - lengths
            hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())], np.uint64)
            ones += np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
            total += len(hashes)
        carry = words[1 - SHINGLE :]
    if not total:
        return digest(b" ".join(carry), SEED) if carry else 0
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def _fingerprint_batches(batches):
    import pyarrow as pa

    for batch in batches:
        values = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64), pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) for every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Positions of the codes x (uint64) in the Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class Forest:
    """Union-find over 0..n-1; a root is its set's least index."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.roots()
            a, b = up[a], up[b]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(self.up, high, low)


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mask and pattern of the groups of each level, the members first."""
    levels = [(np.full(len(codes), ~np.uint64(0)), codes)]
    while len(levels[-1][0]) > FAN:
        mask, pattern = levels[-1]
        cuts = np.arange(0, len(mask), FAN)
        shared = np.bitwise_and.reduceat(mask, cuts) & ~(np.bitwise_or.reduceat(pattern, cuts) ^ np.bitwise_and.reduceat(pattern, cuts))
        levels.append((shared, np.bitwise_and.reduceat(pattern, cuts) & shared))
    return levels


def node_forest(codes: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For each of the Gray-sorted codes of one node, the index of the first code that links lead to."""
    forest = Forest(len(codes))
    near = np.flatnonzero(np.bitwise_count(codes[1:] ^ codes[:-1]) <= max_bits)
    forest.link(near, near + 1)
    levels = _levels(codes)

    def uniform(depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The least root in each group, and whether it is the only one."""
        roots = forest.roots()
        cuts = np.arange(0, len(codes), FAN**depth)
        low, high = np.minimum.reduceat(roots, cuts), np.maximum.reduceat(roots, cuts)
        return low, low == high

    def descend(depth: int, a: np.ndarray, b: np.ndarray) -> None:
        mask, pattern = levels[depth]
        for k in range(0, len(a), 1 << 16):
            x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            ok = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= max_bits
            root, single = uniform(depth)
            ok &= ~(single[x] & single[y] & (root[x] == root[y]))
            x, y = x[ok], y[ok]
            if not depth:
                forest.link(x, y)
                continue
            size, step = len(levels[depth - 1][0]), np.arange(FAN)
            for j in range(0, len(x), 1 << 12):
                low = (x[j : j + (1 << 12), None] * FAN + step).repeat(FAN, 1)
                high = np.tile(y[j : j + (1 << 12), None] * FAN + step, (1, FAN))
                fits = (high < size) & (low < high if depth == 1 else low <= high)
                descend(depth - 1, low[fits], high[fits])

    top = len(levels) - 1
    a, b = np.triu_indices(len(levels[top][0]), 1 if not top else 0)
    descend(top, a, b)
    return forest.roots()


def _node_links(parts):
    """Of rows sorted by node: (a, b) for members of a node that links lead to from its first member."""
    import pyarrow as pa

    def links(node: np.ndarray, codes: np.ndarray):
        """Nodes are whole here."""
        order = np.lexsort((gray_rank(codes), node))
        node, codes = node[order], codes[order]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        sizes = np.diff(np.r_[starts, len(node)])
        few = np.repeat(sizes <= FAN, sizes)
        forest = Forest(len(node))
        for step in range(1, FAN):
            i = np.flatnonzero((node[step:] == node[:-step]) & few[step:]) if step < len(node) else np.empty(0, int)
            i = i[np.bitwise_count(codes[i] ^ codes[i + step]) <= MAX_BITS]
            forest.link(i, i + step)
        roots = forest.roots().copy()
        for start, size in zip(starts[sizes > FAN].tolist(), sizes[sizes > FAN].tolist()):
            roots[start : start + size] = start + node_forest(codes[start : start + size])
        linked = roots != np.arange(len(roots))
        return codes[roots[linked]].view(np.int64), codes[linked].view(np.int64)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in parts:
        node, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(node):
            continue
        held.append((node, codes))
        rows += len(node)
        if rows < 1 << 17 or held[0][0][0] == node[-1]:
            continue
        node, codes = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(node, node[-1]))  # the last node may go on
        held, rows = [(node[cut:], codes[cut:])], len(node) - cut
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(node[:cut], codes[:cut])], ["a", "b"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(*(np.concatenate(x) for x in zip(*held)))], ["a", "b"])


def lower_masks(mask: int, blocks: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks that add whole blocks of the bits mask leaves free: codes that agree in mask and differ in max_bits others agree in one of them."""
    free = [i for i in range(64) if not mask >> i & 1]
    edges = [round(i * len(free) / blocks) for i in range(blocks + 1)]
    whole = [sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:])]
    return [mask | sum(x) for x in combinations(whole, blocks - max_bits)]


def block_masks(rows: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of the first level: so many blocks that unrelated fingerprints seldom share a node."""
    return lower_masks(0, max_bits + (2 if rows < 1 << 23 else 3 if rows < 1 << 29 else 4), max_bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(masked: DataFrame) -> DataFrame:
    """masked: fp, mask. Adds the key of the node. Nodes whose 64-bit keys collide are searched together; every pair's distance is tested, so nothing changes."""
    return masked.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))


def near_links(codes: DataFrame) -> DataFrame:
    """codes: distinct fp. (a, b) so that chains of rows join exactly the fingerprints that chains of links join."""
    spark = codes.sparkSession
    keyed = _keyed(codes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in block_masks(codes.count())])).alias("mask")))
    whole = None
    while True:
        sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("mask").alias("own_mask")).where(F.col("members") > NODE_ROWS)
        large = checkpointed(sizes.select(F.col("key").alias("large_key"), "own_mask"))
        masks = [r["own_mask"] for r in large.select("own_mask").distinct().collect()]  # at most as many as this level has masks
        finer = [(m, [_signed(x) for x in lower_masks(m % (1 << 64), MAX_BITS + 2)]) for m in masks if 64 - (m % (1 << 64)).bit_count() > FEW_FREE]
        if not finer:
            break
        split = spark.createDataFrame(finer, "split_mask long, lower array<long>")
        marked = keyed.join(maybe_broadcast(large.select("large_key"), large.count()), F.col("key") == F.col("large_key"), "left")
        marked = checkpointed(marked.join(F.broadcast(split), F.col("large_key").isNotNull() & (F.col("mask") == F.col("split_mask")), "left"))
        done = marked.where("lower is null").select("fp", "mask", "key")
        whole = done if whole is None else whole.union(done)
        keyed = checkpointed(_keyed(marked.where("lower is not null").select("fp", F.explode("lower").alias("mask")).distinct()))
    keyed = keyed if whole is None else whole.union(keyed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    dealt = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_node_links, "a long, b long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """fp and root (the least fp that links lead to) for every fp in links (a, b), by alternating large and small stars."""
    links = checkpointed(links.where("a <> b"))
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = links.union(links.select("b", "a")).toDF("a", "b")
        least = checkpointed(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")).toDF("node", "low"))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = checkpointed(large.distinct())  # every row points from a larger to a smaller fp
        least = checkpointed(large.groupBy("a").agg(F.min("b").alias("low")).toDF("node", "low"))
        small = large.join(least, F.col("a") == F.col("node")).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = checkpointed(small.union(least.select("node", "low")).distinct().toDF("a", "b"))
    return links.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root (the component's least fp that links lead to) and component_id for every row of docs."""
    marked = checkpointed(fingerprints(docs))
    codes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected(near_links(codes.select("fp")))
    bounded_batches(docs.sparkSession)
    roots = checkpointed(roots.union(roots.select("root", "root")).distinct())
    # The roots' members can be many for one root: both sides of this join are plain tables that AQE can split.
    rooted = checkpointed(roots.join(codes, "fp").select("fp", "root", "first_id"))
    firsts = checkpointed(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    joined = checkpointed(rooted.select("fp", "root").join(firsts, "root").select("fp", "root", "component_id"))
    classes = codes.join(joined, "fp", "left").select(F.col("fp").alias("code"), F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    classes = checkpointed(classes)
    return marked.join(classes, F.col("fp") == F.col("code"), "left").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links lead to) for every row of docs.

    Null and empty texts have fingerprint 0; null doc_ids count as larger than others and get a null component only
    where no other id is in it; repeated rows are repeated; an empty table gives an empty table.
    """
    return components(docs).select("doc_id", unsigned_hex("fp").alias("fingerprint"), "component_id")


def _with_fingerprints(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of fingerprints; no shuffle."""
    from pyspark.sql.types import LongType, StructField, StructType

    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = np.array([fingerprint(x) for x in batch.column(at).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64), pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate component: that with the least doc_id (nulls last); of its rows one.

    Components are told apart by their root fingerprints, so rows with null or repeated doc_ids that no links join all
    stay; of a doc_id's rows in one component that with the least fingerprint stays, then that whose text sorts first.
    """
    found = checkpointed(components(docs).select("doc_id", "fp", "root"))
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "fp")).alias("least"))
    kept = checkpointed(least.select(F.col("least")["doc_id"].alias("doc_id"), F.col("least")["fp"].alias("fp")))
    repeated = checkpointed(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    # all that goes, few beside all that stays: copies, and rows that doc_id alone doesn't tell apart
    copies = found.where("doc_id is not null").select("doc_id").distinct().join(kept.select("doc_id"), "doc_id", "left_anti")
    single = drop_ids(docs.where("doc_id is not null"), checkpointed(copies.union(repeated).distinct()))
    doubtful = kept.where("doc_id is null").union(kept.join(repeated, "doc_id", "left_semi"))
    if doubtful.isEmpty():
        return single
    # rows that doc_id alone doesn't tell apart: by their fingerprints too
    name = fresh(docs, "_fp")
    rows = _with_fingerprints(docs.where("doc_id is null").union(keep_ids(docs, repeated)), name)
    right = doubtful.toDF("_wanted_id", "_wanted_fp")
    same = rows["doc_id"].cast("long").eqNullSafe(right["_wanted_id"]) & (rows[name] == right["_wanted_fp"])
    least = rows.join(right, same, "left_semi").groupBy("doc_id", name).agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row"))
    return single.union(least.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
