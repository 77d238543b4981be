"""Lines and symbols: range joins, counterparts in the other revision, and lines that no symbol covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bucket; a span is listed under each bucket it touches, so joins are on equal keys.
BUCKET = 64


def narrowest_spans(lines: DataFrame, spans: DataFrame, group: str, bucket: int = BUCKET) -> DataFrame:
    """group, line, span_id and width of the narrowest spans that contain each line; ties are all kept.

    lines: group, line; spans: group, span_id, start_line, end_line. Both meet by group and bucket of lines.
    """
    listed = spans.where("end_line >= start_line").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))))
    own = lines.withColumn("bucket", F.floor(F.col("line") / bucket))
    joined = own.join(listed, [group, "bucket"]).where("line between start_line and end_line")
    width = joined.withColumn("width", F.col("end_line") - F.col("start_line"))
    ranked = width.withColumn("place", F.rank().over(Window.partitionBy(group, "line").orderBy("width")))
    return ranked.where("place = 1").select(group, "line", "span_id", "width")


def overlaps(lines: DataFrame, spans: DataFrame, group: str) -> DataFrame:
    """group, span_id, n_lines and lines (sorted) of every symbol that a changed line belongs to."""
    found = narrowest_spans(lines, spans, group)
    return found.groupBy(group, "span_id").agg(F.countDistinct("line").alias("n_lines"), F.array_sort(F.collect_set("line")).alias("lines"))


def unmapped(lines: DataFrame, spans: DataFrame, group: str) -> DataFrame:
    """group and line of lines that no span contains."""
    return lines.join(narrowest_spans(lines, spans, group).select(group, "line").distinct(), [group, "line"], "left_anti")


def counterparts(symbols: DataFrame, opposite: DataFrame, known: DataFrame, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of opposite that have the identity of a symbol and aren't known already; and each identity's coverage.

    The second table has identity and found: the lookup was made, whatever it gave, which is what proves an absence.
    """
    wanted = symbols.select(*identity).distinct()
    found = opposite.join(wanted, identity, "left_semi")
    fresh = found.join(known.select(*identity).distinct(), identity, "left_anti")
    coverage = wanted.join(found.select(*identity).distinct().withColumn("found", F.lit(True)), identity, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return fresh, coverage


def index_state(requested: DataFrame, indexed: DataFrame) -> DataFrame:
    """path and state of each requested file (path, content_hash): available, stale (another hash) or missing."""
    joined = requested.join(indexed.select("path", F.col("content_hash").alias("indexed_hash")), "path", "left")
    state = F.when(F.col("indexed_hash").isNull(), "missing").when(F.col("indexed_hash") != F.col("content_hash"), "stale").otherwise("available")
    return joined.select("path", state.alias("state"))


def index_summary(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys and state of a whole index: stale over missing (nothing there) and partial over available."""
    counted = states.groupBy(*keys).agg(F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "missing").alias("missing"), F.count("*").alias("total"))
    state = F.when(F.col("stale") > 0, "stale").when((F.col("total") > 0) & (F.col("missing") == F.col("total")), "missing").when(F.col("missing") > 0, "partial").otherwise("available")
    return counted.select(*keys, state.alias("state"))
