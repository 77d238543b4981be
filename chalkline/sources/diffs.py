"""Unified diffs as rows: lines, counters by running sums, and runs of changed lines as relations. No Python code runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^@@\s+-([0-9]+)(?:,([0-9]+))?\s+\+([0-9]+)(?:,([0-9]+))?\s+@@"
NO_NEWLINE = "\\ No newline at end of file"


def patch_lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hunk (from 0), position, mark (+, - or blank), number and text of every line of hunks in files (patch).

    Lines that begin with +++ or --- count as context, as in the format this follows: a header look-alike in a hunk
    moves both counters. The number is the head's for added and context lines, the base's for removed ones.
    """
    lines = files.select(*keys, F.posexplode(F.split(F.regexp_replace("patch", r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n", -1)).alias("position", "raw"))
    lines = lines.where(F.col("raw") != NO_NEWLINE)
    order = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.col("raw").rlike(HEADER)
    lines = lines.withColumn("hunk", F.sum(header.cast("int")).over(order) - 1).where("hunk >= 0")
    mark = F.when(header, "@").when(F.col("raw").startswith("+") & ~F.col("raw").startswith("+++"), "+").when(F.col("raw").startswith("-") & ~F.col("raw").startswith("---"), "-").otherwise(" ")
    lines = lines.withColumn("mark", mark)
    within = Window.partitionBy(*keys, "hunk").orderBy("position")
    whole, before = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), within.rowsBetween(Window.unboundedPreceding, -1)
    for k, name in enumerate(("old_start", "old_count", "new_start", "new_count"), 1):
        value = F.coalesce(F.regexp_extract("raw", HEADER, k).try_cast("int"), F.lit(1))
        lines = lines.withColumn(name, F.first(F.when(F.col("mark") == "@", value), ignorenulls=True).over(whole))
    count = lambda marks: F.coalesce(F.sum(F.col("mark").isin(*marks).cast("int")).over(before), F.lit(0))
    number = F.when(F.col("mark") == "-", F.col("old_start") + count("- ")).otherwise(F.col("new_start") + count("+ "))
    lines = lines.withColumn("number", number.cast("int")).withColumn("changed", F.col("mark").isin("+", "-"))
    opens = F.col("changed") & ~F.coalesce(F.lag("changed").over(within), F.lit(False))
    lines = lines.withColumn("relation", F.sum(opens.cast("int")).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return lines.select(*keys, "hunk", "position", "mark", "number", F.substring("raw", 2, 1 << 30).alias("text"), "relation", "old_start", "old_count", "new_start", "new_count")


def hunks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hunk and its header's numbers, of patch_lines()."""
    return lines.where("mark = '@'").select(*keys, "hunk", "old_start", "old_count", "new_start", "new_count")


def hunk_id(base_path, head_path, hunk):
    """hunk:PATH:ORDINAL, or both paths with an arrow between where they differ."""
    one, both = F.coalesce(base_path, head_path), F.concat(F.coalesce(base_path, F.lit("")), F.lit("→"), F.coalesce(head_path, F.lit("")))
    return F.concat(F.lit("hunk:"), F.when(base_path.eqNullSafe(head_path), one).otherwise(both), F.lit(":"), hunk.cast("string"))


def change_relations(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hunk, ordinal, kind and added and removed lines (arrays of number, text) of each run of changed lines."""
    picked = lambda mark: F.array_sort(F.collect_list(F.when(F.col("mark") == mark, F.struct("position", "number", "text"))))
    folded = lines.where("mark in ('+', '-')").groupBy(*keys, "hunk", F.col("relation").alias("ordinal")).agg(picked("+").alias("a"), picked("-").alias("r"))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text")))
    kind = F.when(F.size("r") == 0, "added").when(F.size("a") == 0, "removed").otherwise("replaced")
    return folded.select(*keys, "hunk", "ordinal", kind.alias("kind"), plain("a").alias("added"), plain("r").alias("removed"))


def missing_patches(files: DataFrame, keys: list[str]) -> DataFrame:
    """A diagnostic for each file without a patch."""
    return files.where("patch is null or patch = ''").select(*keys, F.lit("missing_patch").alias("code"), F.lit("warning").alias("severity"))


def added_removed_paths(files: DataFrame) -> DataFrame:
    """files (filename, previous_filename, status) with base_path (null if added) and head_path (null if removed)."""
    base = F.when(F.col("status") != "added", F.coalesce("previous_filename", "filename"))
    return files.withColumn("base_path", base).withColumn("head_path", F.when(F.col("status") != "removed", F.col("filename")))
