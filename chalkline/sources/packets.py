"""Review packets from JSON, with their schema stated and their digests checked."""

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = "array<struct<label:string,url:string,path:string,line_start:int,line_end:int>>"
PACKET = (
    "schema_version:string,packet_revision:string,repository:string,pull_request:int,title:string,source_url:string,head_sha:string,base_sha:string,"
    "source_records:array<struct<id:string,kind:string,repository:string,url:string,title:string,body:string,revision:string,availability:string>>,"
    "changed_files:array<struct<base_path:string,head_path:string,status:string,additions:int,deletions:int,changes:int,source_url:string,patch:string>>,"
    "verification_observations:array<struct<id:string,name:string,kind:string,status:string,conclusion:string,head_sha:string,details_url:string,provider:string>>,"
    f"diagnostics:array<struct<code:string,message:string,severity:string,sources:{SOURCES}>>,metadata:map<string,string>"
)
SCHEMA = (
    f"schema_version string, source_packet struct<{PACKET}>, "
    f"requirements array<struct<id:string,text:string,role:string,purpose:string,authority:string,kind:string,sources:{SOURCES}>>, "
    f"evidence array<struct<statement_ids:array<string>,summary:string,kind:string,classification:string,sources:{SOURCES}>>"
)
#: The envelope's version that is read; other rows are refused.
VERSION = "analysis_fixture.v3"


def packet_digest(text: str | None) -> str | None:
    """sha256: and the digest of the packet's sorted compact JSON without its own revision."""
    if text is None:
        return None
    packet = json.loads(text)
    packet.pop("packet_revision", None)
    return "sha256:" + hashlib.sha256(json.dumps(packet, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """parse_packets() of the JSON files at path, one review each."""
    return parse_packets(spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file")))


def parse_packets(raw: DataFrame) -> DataFrame:
    """review_id, file, packet, requirements, evidence and refusal (null if the document is fit) of raw (value, file), which may be a stream."""
    import pandas as pd

    def digests(column: pd.Series) -> pd.Series:
        return column.map(packet_digest)

    read = raw.withColumn("j", F.from_json("value", SCHEMA)).withColumn("inner", F.get_json_object("value", "$.source_packet"))
    read = read.withColumn("digest", F.pandas_udf(digests, "string")("inner"))
    packet = F.col("j.source_packet")
    known = F.transform("j.requirements", lambda r: r["id"])
    unknown = F.exists("j.evidence", lambda e: F.size(F.array_except(e["statement_ids"], known)) > 0)
    refusal = (
        F.when(packet.isNull(), "unreadable")
        .when(F.coalesce(F.col("j.schema_version"), F.lit("")) != VERSION, "schema_version")
        .when(packet["packet_revision"].isNotNull() & (packet["packet_revision"] != F.col("digest")), "digest")
        .when((F.size("j.requirements") > 0) & unknown, "unknown_statement")
    )
    review = F.concat_ws("#", packet["repository"], packet["pull_request"].cast("string"))
    return read.select(F.coalesce(review, F.col("file")).alias("review_id"), "file", packet.alias("packet"), F.col("j.requirements").alias("requirements"), F.col("j.evidence").alias("evidence"), "digest", refusal.alias("refusal"))


def _exploded(packets: DataFrame, column: str) -> DataFrame:
    return packets.where("refusal is null").select("review_id", F.posexplode(f"packet.{column}").alias("ordinal", "row")).select("review_id", "ordinal", "row.*")


def records(packets: DataFrame) -> DataFrame:
    return _exploded(packets, "source_records")


def changed_files(packets: DataFrame) -> DataFrame:
    return _exploded(packets, "changed_files")


def observations(packets: DataFrame) -> DataFrame:
    return _exploded(packets, "verification_observations").withColumnRenamed("id", "observation_id")


def supplied(packets: DataFrame) -> DataFrame:
    return packets.where("refusal is null").select("review_id", F.posexplode("evidence").alias("ordinal", "row")).select("review_id", "ordinal", "row.*")


def checks(runs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Observations of check runs (review_id, id, name, status, conclusion, head_sha) and commit statuses (review_id, id,
    context, state, head_sha): a status is completed unless its state is pending or missing."""
    text = lambda c, empty: F.when(F.coalesce(F.col(c), F.lit("")) == "", empty).otherwise(F.col(c))
    ran = runs.select("review_id", F.concat(F.lit("check-run:"), F.col("id").cast("string")).alias("observation_id"), text("name", "check run").alias("name"), F.lit("check_run").alias("kind"), text("status", "unknown").alias("status"), F.coalesce("conclusion", F.lit("")).alias("conclusion"), "head_sha")
    done = F.when(F.col("state").isNull() | (F.col("state") == "pending"), "pending").otherwise("completed")
    told = statuses.select("review_id", F.concat(F.lit("commit-status:"), F.col("id").cast("string")).alias("observation_id"), text("context", "commit status").alias("name"), F.lit("commit_status").alias("kind"), done.alias("status"), F.coalesce("state", F.lit("")).alias("conclusion"), "head_sha")
    return ran.unionByName(told)


def linked_issues(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source records of linked issues (review_id, repository, number, title, body, url), and reviews with more than one."""
    named = nodes.where("number is not null").withColumn("title", F.when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit("Issue #"), F.col("number").cast("string"))).otherwise(F.col("title"))).withColumn("body", F.coalesce("body", F.lit("")))
    revision = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\0", "title", "body").cast("binary"), 256))
    found = named.select("review_id", F.concat(F.lit("issue:"), "repository", F.lit("#"), F.col("number").cast("string")).alias("id"), F.lit("linked_issue").alias("kind"), "repository", "url", "title", "body", revision.alias("revision"))
    several = found.groupBy("review_id").agg(F.count("*").alias("n")).where("n > 1").select("review_id", F.lit("linked_issues_ambiguous").alias("code"), "n")
    return found, several
