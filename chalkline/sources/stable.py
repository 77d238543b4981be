"""Byte-stable tables: canonical JSON lines in a total order, and one digest that doesn't depend on how Spark dealt the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from chalkline.operators.stages import kept

#: Children of a node of the digest tree; a node's task holds 64 characters for each.
FANOUT = 4096


def _sorted(value: Column, kind: DataType) -> Column:
    """value with the fields of all its structs in the order of their names."""
    if isinstance(kind, StructType):
        fields = [_sorted(value[n], kind[n].dataType).alias(n) for n in sorted(kind.names)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    return value


def canonical_lines(df: DataFrame) -> Column:
    """A row of df as compact JSON with sorted fields, nulls told; maps keep the order of their entries."""
    fields = [_sorted(F.col(f"`{n}`"), df.schema[n].dataType).alias(n) for n in sorted(df.columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def sorted_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """ordinal (from 0) and line of df's rows, by the order's columns and then by the lines; repeated rows are repeated lines.

    The sort is by ranges and written once; a row's ordinal is its place in its range and the sum of the ranges before, so
    no window sees more than a row for each range.
    """
    ranged = kept(df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], canonical_lines(df).alias("line")).orderBy(*[f"_{i}" for i in range(len(order))], "line").select("line"))
    place = F.monotonically_increasing_id()
    rows = ranged.select("line", F.shiftright(place, 33).alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("within"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(counts, "range").select((F.col("before") + F.col("within")).alias("ordinal"), "line")


def digest_tree(lines: DataFrame, fanout: int = FANOUT, levels: int | None = None) -> DataFrame:
    """level (from 1), node and digest of a hash tree over lines (ordinal, line), up to its one root; no lines, no nodes.

    levels: how many of the lowest to tell; None: all.

    A leaf is the SHA-256 of a line, a node that of its children's hex digests in order. Equal rows give equal trees, however
    they were dealt; trees of two tables differ in just the nodes above rows that differ.
    """
    nodes = lines.select(F.col("ordinal").alias("node"), F.sha2("line", 256).alias("digest"))
    level, n, out = 0, None, None
    while n is None or (n > 1 and level != levels):
        level += 1
        grouped = nodes.groupBy(F.expr(f"node div {fanout}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("c"))
        nodes = kept(grouped.select(F.col("up").alias("node"), F.sha2(F.array_join("c.digest", ""), 256).alias("digest")))
        n = nodes.count()
        told = nodes.select(F.lit(level).alias("level"), "node", "digest")
        out = told if out is None else out.union(told)
    return out


def write_table(df: DataFrame, path: str, order: list[str]) -> str | None:
    """Writes df as canonical lines, part files in their order, and gives its digest (None for no rows)."""
    lines = kept(sorted_lines(df, order))
    lines.orderBy("ordinal").select("line").write.mode("overwrite").text(path)
    root = digest_tree(lines).orderBy(F.desc("level")).first()
    return root.digest if root else None
