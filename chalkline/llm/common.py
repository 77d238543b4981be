"""What the operators of this subpackage share: reading, checkpoints, row batches, fresh column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a Python worker gets at once, and bytes where rows are long.
BATCH_ROWS, BATCH_BYTES = 256, 64 << 20
#: Rows that a table may have to be broadcast by request, and rows of one number each; beyond it Spark shuffles.
BROADCAST_ROWS, BROADCAST_IDS = 100_000, 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one where that is unset on one machine (tests)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chalkline-")
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/chalkline-{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage; its rows are in the shared folder and survive lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """Keep a Python worker's batches small, whatever the length of the texts (a batch ends with the row that passes the bound)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are few; otherwise Spark shuffles it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Shared:
    """A value of bounded size sent once to each executor; pickled by value, as executors may not have this package."""

    def __init__(self, spark: SparkSession, value):
        from pyspark import cloudpickle

        self.pickled, self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"pickled": self.pickled, "held": None}

    @property
    def value(self):
        if self.held is None:
            import pickle

            self.held = pickle.loads(self.pickled.value)
        return self.held

    def unpersist(self) -> None:
        self.pickled.unpersist()


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and the text's UTF-8 bytes, nothing else of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in the only column of ids; null ids match null ids."""
    key = fresh(docs, "_kept_id")
    right = ids.toDF(key)
    return docs.join(right, docs["doc_id"].cast("long").eqNullSafe(right[key]), "left_semi")


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't in the only column of ids (distinct, no nulls); up to BROADCAST_IDS no text is shuffled."""
    key = fresh(docs, "_dropped_id")
    right = ids.toDF(key)
    if ids.count() <= BROADCAST_IDS:
        right = F.broadcast(right)
    return docs.join(right, docs["doc_id"].cast("long") == right[key], "left_anti")


def gathered(batches, column: int, size: int):
    """Arrow batches joined until the binary column has so many bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, used = [], 0
    for batch in batches:
        held.append(batch)
        used += pc.sum(pc.binary_length(batch.column(column).cast(pa.binary()))).as_py() or 0
        if used >= size:
            yield pa.concat_batches(held)
            held, used = [], 0
    if held:
        yield pa.concat_batches(held)


def filtered(docs: DataFrame, keep, size: int = 0) -> DataFrame:
    """Rows of docs for which keep says so; keep gets a list of texts (UTF-8 bytes or None) and gives a list of booleans.

    One pass without any shuffle: each row is judged by its own text and keeps all its columns; size: bytes of texts
    that keep gets at once, where there are so many.
    """
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches):
        import pyarrow as pa

        for batch in gathered(batches, at, size):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def unsigned_hex(column) -> F.Column:
    """A long's 64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
