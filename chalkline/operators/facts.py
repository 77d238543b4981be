"""Facts: identities, merging by identity, lanes, and the facts that changes, checks and supplied notes give."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.lexical import association_signature
from chalkline.functions.paths import fact_profile, path_classification


def evidence_id(kind: Column | str, *identity: Column) -> Column:
    """E:, the kind, and 20 hex digits of the digest of kind and identity, joined by NUL."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("E:"), kind, F.lit(":"), F.substring(F.sha2(F.concat_ws("\0", kind, *[i.cast("string") for i in identity]).cast("binary"), 256), 1, 20))


def merged_operation(operations: Column) -> Column:
    """Of the distinct operations of changed rows: added if there is no other, else replaced; null if there is none."""
    return F.when(F.size(operations) == 0, F.lit(None).cast("string")).when(F.size(operations) == 1, operations[0]).otherwise("replaced")


def merge_facts(rows: DataFrame, keys: list[str], ordinal: str, first: list[str] = (), unions: list[str] = (), changed: str = "changed", operation: str | None = None) -> DataFrame:
    """One row for each identity: changed is OR, first come the earliest row's, unions are sorted distinct.

    A null in a first column is filled from the next row that has a value. first columns beside changed rows: summary
    columns may be picked by passing them through `when(changed, ...)`.
    """
    place = F.col(ordinal)
    out = [F.bool_or(changed).alias(changed)]
    out += [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in first]
    out += [F.array_sort(F.collect_set(c)).alias(c) for c in unions]
    if operation:
        out.append(F.array_sort(F.collect_set(F.when(F.col(changed), F.col(operation)))).alias(operation))
    folded = rows.groupBy(*keys).agg(*out)
    return folded.withColumn(operation, merged_operation(F.col(operation))) if operation else folded


def kind_conflicts(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Identities with rows of several kinds, which merging must not meet."""
    return rows.groupBy(*keys).agg(F.count_distinct(kind).alias("kinds")).where("kinds > 1")


def lanes(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """columns of all parts with their lane."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("lane"), *columns) for name, df in parts.items()])


def change_facts(relations: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A fact for each change relation (base_path, head_path, hunk_id, ordinal, kind, added, removed: arrays of number, text).

    The identity holds the added lines' numbers only, as the format has it.
    """
    path = F.when(F.col("kind") == "removed", F.coalesce("base_path", "head_path")).otherwise(F.coalesce("head_path", "base_path"))
    relation = F.concat("hunk_id", F.lit(":change:"), F.col("ordinal").cast("string"))
    numbers = F.array_join(F.transform("added", lambda x: x["number"].cast("string")), ",")
    text = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "\n")
    shown = F.when(F.size("added") > 0, F.col("added")).otherwise(F.col("removed"))
    first, last = F.array_min(F.transform(shown, lambda x: x["number"])), F.array_max(F.transform(shown, lambda x: x["number"]))
    summary = F.format_string("%s change: %s:%d-%d", F.initcap("kind"), path, first, last)
    rows = relations.select(*keys, "base_path", "head_path", "kind", relation.alias("relation_id"), path.alias("path"), numbers.alias("numbers"), first.alias("first_line"), summary.alias("summary"), text("added").alias("head_text"), text("removed").alias("base_text"))
    return rows.select(
        *keys,
        evidence_id("change_relation", F.concat_ws(":", "relation_id", "numbers")).alias("id"),
        F.lit("change_relation").alias("kind"),
        F.lit("changed_anchor").alias("role"),
        "summary",
        "path",
        "first_line",
        F.col("kind").alias("operation"),
        F.when(F.col("kind") == "removed", "base").otherwise("head").alias("revision_side"),
        F.lit(True).alias("changed"),
        fact_profile(F.col("path")).alias("profile"),
        path_classification(F.col("path")).alias("classification"),
        association_signature(F.col("summary"), F.col("path"), F.col("head_text")).alias("head_signature"),
        association_signature(F.col("summary"), F.col("path"), F.col("base_text")).alias("base_signature"),
        F.array("relation_id").alias("change_relation_ids"),
    )


def file_facts(files: DataFrame, hunked: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A fact for each changed file (base_path, head_path, status) without hunks (hunked: keys and path)."""
    shown = files.withColumn("path", F.coalesce("head_path", "base_path"))
    bare = shown.join(hunked.select(*keys, "path").distinct(), [*keys, "path"], "left_anti")
    named = F.when(F.col("status") == "renamed", F.concat("base_path", F.lit(" → "), "head_path")).otherwise(F.col("path"))
    operation = F.when(F.col("status").isin("removed", "added", "renamed"), F.col("status")).otherwise("modified")
    none = association_signature(F.lit(""))
    rows = bare.withColumn("summary", F.concat(F.initcap("status"), F.lit(" file: "), named))
    return rows.select(
        *keys,
        evidence_id("changed_file", F.col("path")).alias("id"),
        F.lit("changed_file").alias("kind"),
        F.lit("changed_anchor").alias("role"),
        "summary",
        "path",
        F.lit(0).alias("first_line"),
        operation.alias("operation"),
        F.when(F.col("status") == "removed", "base").otherwise("head").alias("revision_side"),
        F.lit(True).alias("changed"),
        fact_profile(F.col("path")).alias("profile"),
        path_classification(F.col("path")).alias("classification"),
        association_signature(F.col("summary"), F.col("path")).alias("head_signature"),
        none.alias("base_signature"),
        F.array().cast("array<string>").alias("change_relation_ids"),
    )


def canonical_name(name):
    """A check's name in compatibility form, white space collapsed, case folded. Normal forms aren't in Spark SQL, so Python does this."""
    import unicodedata

    import pandas as pd

    def names(column: pd.Series) -> pd.Series:
        return column.map(lambda x: " ".join(unicodedata.normalize("NFKC", x or "").split()).casefold())

    return F.pandas_udf(names, "string")(name)


def check_facts(observations: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A fact for each check (observation_id, name, kind, provider, status, conclusion, head_sha)."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    filled = lambda c: F.when(plain(c) == "", "unknown").otherwise(plain(c))
    return observations.select(
        *keys,
        evidence_id("verification", F.col("observation_id")).alias("id"),
        "kind",
        F.lit("verification").alias("role"),
        F.concat("name", F.lit(": "), "status", F.lit("/"), F.when(F.coalesce("conclusion", F.lit("")) == "", "no conclusion").otherwise(F.col("conclusion"))).alias("summary"),
        F.struct(filled("provider").alias("provider"), F.col("kind").alias("kind"), canonical_name(F.col("name")).alias("name")).alias("identity"),
        filled("status").alias("status"),
        plain("conclusion").alias("conclusion"),
        "head_sha",
        F.lit("verification").alias("profile"),
        F.when(F.col("kind") == "manual", "runtime").otherwise("ci").alias("classification"),
    )


def supplied_facts(notes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A fact for each supplied note (summary, kind, classification, sources, statement_ids); identities are compact sorted JSON.

    Characters beyond ASCII stay as they are in that JSON, where other writers may escape them.
    """
    source = lambda s: F.struct(*[s[c].alias(c) for c in ("label", "line_end", "line_start", "path", "url")])
    identity = F.to_json(
        F.struct("classification", "kind", F.transform("sources", source).alias("sources"), "statement_ids", "summary"),
        {"ignoreNullFields": "false"},
    )
    profile = F.when(F.col("classification").isin("ci", "runtime"), "verification").when(F.col("classification").isin("test", "document"), F.col("classification")).otherwise("production")
    return notes.select(
        *keys,
        evidence_id("provided", identity).alias("id"),
        "kind",
        F.lit("provided_context").alias("role"),
        "summary",
        profile.alias("profile"),
        "classification",
        "statement_ids",
    )
