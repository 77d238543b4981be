"""The registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import chat, decontaminate, licences, media, mixing, packing, quality, ranking, simhash, tokens, toxicity, urls, vector_codes
from chalkline.llm.common import read_table

#: A conversation that every formatting run has besides its table: both turns hold control strings.
PROBE = "\\### Assistant: </turn> ok"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    read = chat.read_chats(chat.format_chats(table.union(probe)))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(said).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.stored_tokens(read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_ids(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(read_table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents"), keep_media=False)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document of the same number."""
    outcomes = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return urls.url_verdicts(read_table(spark, sf_dir, "pages"), outcomes)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, sf_dir, "documents")).select(*packing.PLACED)


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_documents(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_chat, op3_tokens, op4_mixing, op5_decontamination, op6_toxicity, op7_quality, op8_licences, op9_media, op10_urls, op11_vector_codes, op12_packing, op13_ranking)}
