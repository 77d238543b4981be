"""Product-quantised vector codes, their codebooks learned by delta-maintained Lloyd rounds.

Components become integers (floor of SCALE times the component) and vectors are cut into PARTS equal parts, each with a
codebook of its own. Vectors are packed into blocks of BLOCK_ROWS once and written bucketed by block. Each round reads
the blocks beside the assignments of the round before (bucketed alike, so Spark joins them without a shuffle), assigns
every part to its nearest entry and writes the new assignments, with plus and minus contributions only of parts whose
assignment changed. These contributions alone are shuffled, summed by part and entry, and added to running integer
counts and sums, of which there are entries x length whatever the data. All arithmetic is on integers, so neither order
nor lost executors change a result.

Rows whose vector is null or has null or non-finite components are left out. Components saturate at +-2**26 (that is
16,384 times SCALE), so sums can't overflow. Vectors shorter than the longest, or than a multiple of PARTS, get zeros
behind. A codebook begins with the least vec_ids; of rows that share one the least vector counts, a missing vec_id comes
last; fewer vectors make smaller codebooks. Repeated rows are coded each; an empty table gives no rows; null labels are
one label; other columns are left out.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm.common import checkpointed, maybe_broadcast, shared_path

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block, the row that Spark joins.
BLOCK_ROWS = 512
LIMIT = float(1 << 26)
CHANGES = "array<struct<part:int,entry:int,n:bigint,sums:array<bigint>>>"


@contextlib.contextmanager
def scratch_tables(spark: SparkSession):
    """Names of new tables in the shared folder; all of them go, with their files, at the end."""
    database = f"chalkline_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_path(spark, 'tables')}'")
    try:
        yield lambda name: f"{database}.{name}"
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and components (array of long) of the rows of vectors (vec_id, embedding, label) that have a whole vector."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.col("embedding").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    floors = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c * SCALE))))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "label", floors.alias("components"))


def first_vectors(kept: DataFrame, count: int) -> list[list[int]]:
    """Components of the count least vec_ids; a pass takes the least rows of each task, never all."""
    found: dict = {}
    rest = kept
    while len(found) < count:
        rows = rest.orderBy(F.asc_nulls_last("vec_id"), "components").limit(count).collect()
        for r in rows:
            found.setdefault(r.vec_id, r.components)
        if len(rows) < count or rows[-1].vec_id is None:
            break
        rest = kept.where((F.col("vec_id") > rows[-1].vec_id) | F.col("vec_id").isNull())
    return list(found.values())[:count]


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part of vectors (rows, parts, width); books: parts, entries, width; ties go to the lower entry."""
    width = vectors.shape[2]
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(books).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, width) < 1 << 52 else np.int64  # whole numbers below 2**53 are exact
    v, b = vectors.astype(kind).transpose(1, 0, 2), books.astype(kind)
    squares = (v * v).sum(2)[:, :, None] + (b * b).sum(2)[:, None, :]
    distances = squares - 2 * np.matmul(v, b.transpose(0, 2, 1))
    entries = distances.argmin(2)
    return entries.T.astype(np.uint8), np.take_along_axis(distances, entries[:, :, None], 2)[:, :, 0].T.astype(np.int64)


def _pack(batches):
    import pyarrow as pa

    task, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(k, BLOCK_ROWS)
            n, values = part.num_rows, part.column(2).flatten().to_numpy(zero_copy_only=False)
            one = pa.array([0, n], pa.int32())
            columns = [pa.array([(task << 33) + count], pa.int64()), pa.ListArray.from_arrays(one, part.column(0)), pa.ListArray.from_arrays(one, part.column(1)), pa.array([values.astype("<i4").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "vec_ids", "labels", "components"])
            count += 1


def _unpacked(data: bytes, books: np.ndarray) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, books.shape[0], books.shape[2]).astype(np.int64)


def contributions(vectors: np.ndarray, entries: np.ndarray, before: np.ndarray | None, books: np.ndarray) -> list[dict]:
    """Plus and minus of counts and sums, by part and entry, of the parts whose entry isn't the one before."""
    counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    changed = np.ones(entries.shape, bool) if before is None else entries != before
    rows, parts = np.nonzero(changed)
    for sign, of in ((1, entries), (-1, before)):
        if of is not None:
            at = (parts, of[rows, parts])
            np.add.at(counts, at, sign)
            np.add.at(sums, at, sign * vectors[rows, parts])
    return [{"part": int(p), "entry": int(e), "n": int(counts[p, e]), "sums": sums[p, e].tolist()} for p, e in np.argwhere((counts != 0) | (sums != 0).any(2))]


def _assign(books: np.ndarray):
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
        for batch in batches:
            codes, changes = [], []
            for data, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                vectors = _unpacked(data, books)
                entries, _ = nearest(vectors, books)
                changes.append(contributions(vectors, entries, None if before is None else np.frombuffer(before, np.uint8).reshape(entries.shape), books))
                codes.append(entries.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(changes, kind)], ["block", "codes", "changes"])

    return run


def _final(books: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, data in enumerate(batch.column(2).to_pylist()):
                entries, distances = nearest(_unpacked(data, books), books)
                columns = [batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten(), pa.array([r.tobytes().hex() for r in entries], pa.string()), pa.array(distances.sum(1))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def _added(changes: DataFrame, counts: np.ndarray, sums: np.ndarray) -> None:
    """Add the contributions to the running counts and sums; a row for each part, entry and place comes to the driver."""
    each = changes.select(F.explode("changes").alias("c")).select("c.part", "c.entry", F.posexplode(F.concat(F.array("c.n"), "c.sums")))
    for part, entry, place, total in each.groupBy("part", "entry", "pos").agg(F.sum("col").alias("total")).collect():
        if place:
            sums[part, entry, place - 1] += total
        else:
            counts[part, entry] += total


def learn_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code and error of every whole vector; the final codebooks as parts x entries x width)."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte a part")
    spark, kept = vectors.sparkSession, integer_vectors(vectors)
    kind = kept.schema["label"].dataType.simpleString()
    longest = kept.agg(F.max(F.size("components"))).first()[0]
    schema = f"vec_id long, label {kind}, code string, error long"
    if longest is None:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    width = max(1, -(-longest // parts))
    kept = kept.withColumn("components", F.concat("components", F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("components"))))
    books = np.array(first_vectors(kept, entries), np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch_tables(spark) as table:

        def write(df: DataFrame, name: str) -> DataFrame:
            df.write.bucketBy(n, "block").sortBy("block").format("parquet").saveAsTable(table(name))
            return spark.table(table(name))

        packed = kept.mapInArrow(_pack, f"block long, vec_ids array<long>, labels array<{kind}>, components binary")
        blocks = write(packed.repartition(n, "block"), "blocks")
        before = None
        for k in range(rounds):
            given = blocks.select("block", "components")
            given = given.withColumn("codes", F.lit(None).cast("binary")) if before is None else given.join(before.select("block", "codes"), "block")
            state = write(given.mapInArrow(_assign(books), f"block long, codes binary, changes {CHANGES}"), f"round_{k}")
            _added(state, counts, sums)
            if before is not None:
                spark.sql(f"DROP TABLE {table(f'round_{k - 1}')}")
            used = counts > 0
            books = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], books)
            before = state
        return checkpointed(blocks.select("vec_ids", "labels", "components").mapInArrow(_final(books), schema)), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(code: str, books: np.ndarray) -> list[float]:
    """The vector that a code stands for, entries' components divided by SCALE."""
    return (np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(code))]) / SCALE).tolist()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every whole vector."""
    rows, books = learn_codes(vectors)
    totals = checkpointed(rows.groupBy("label").agg(F.sum("error").alias("label_error")))
    joined = rows.join(maybe_broadcast(totals.withColumnRenamed("label", "_label"), totals.count()), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
