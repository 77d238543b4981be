"""Labelled rows to learn from, and the split that keeps a quarter of all rows out of learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import checkpointed, id_and_text

#: At most so many labelled rows, and bytes of their texts, are learned from.
SAMPLE_ROWS, SAMPLE_BYTES = 5000, 32 << 20
BUCKETS = 1 << 30


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """Texts and labels of documents that aren't held out: of all labelled ones, those whose hashed doc_id comes first.

    A document whose text doesn't fit into what is left of the bytes is passed over. Null labels are skipped; of several
    labels of a document the largest counts, of several texts the first in byte order; null texts count as empty.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y is not null")
    own = own.where(~held_out(F.col("key"))).groupBy("key").agg(F.max("y").alias("y"))
    bucket = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(BUCKETS))
    total = own.count()
    # the share of the buckets that has rows enough, with some to spare; the exact cut follows
    share = min(1.0, 1.1 * rows / max(1, total) + 50 / max(1, total))
    picked = own.withColumn("bucket", bucket).where(F.col("bucket") < int(share * BUCKETS))
    found = id_and_text(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("key"))
    found = checkpointed(found.groupBy("bucket", "key", "y").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text")))
    sizes = found.select("bucket", "key", F.length("text").alias("n")).orderBy("bucket", "key").limit(rows).collect()
    left, fitting = size, []
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
            fitting.append((r["key"],))
    kept = F.broadcast(docs.sparkSession.createDataFrame(fitting, "fitting long"))  # at most so many rows as the sample
    return [(bytes(r["text"]), r["y"]) for r in sorted(found.join(kept, F.col("key") == F.col("fitting")).select("bucket", "key", "y", "text").collect())]
