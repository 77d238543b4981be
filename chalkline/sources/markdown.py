"""Authored Markdown as typed statements, by windows over the lines of each body.

A line's state comes from running counts: it is fenced if the fence marks alike in a row before it are odd in number; its
section is the last heading's; its block ends with the next heading, fence mark or empty line. A block's lines before its
first list item are a paragraph, each item takes the lines behind it, and an item's parents are, for each lesser indent,
the last item before it that is no deeper. Only items without children are statements, with their parents' texts before
their own.

Null bodies have no statements; keys must tell bodies apart; of statements that differ by case alone the first counts.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import headings as H

#: Roles of sections whose paragraphs are statements too; those of transformation kinds always are.
PARAGRAPH_ROLES = ("objective", "claim", "context")
SECTION = "struct<title:string,role:string,purpose:string,kind:string>"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cleaned(text: Column) -> Column:
    """Without comments, code ticks, link targets and emphasis; white space collapsed."""
    plain = reduce(lambda x, rule: F.regexp_replace(x, F.lit(rule[0]), F.lit(rule[1])), H.MARKUP, text)
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def heading_name(text: Column) -> Column:
    """The name that headings are known by: lower case, one space for any separator, no numbering, closing remark or edge marks."""
    spaced = F.rtrim(F.translate(F.lower(cleaned(text)), "/|:–—-", " " * 6))
    bare = F.regexp_replace(F.regexp_replace(spaced, r" *\([^)]*\) *$", ""), r"^\d+[.)] *", "")
    return F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("&"), F.lit(" and ")), " +", " "), "^[^a-z0-9]+|[^a-z0-9]+$", "")


def numbered_parts(text: Column) -> Column:
    """The items of an explicit inline numbering, if it has two at least; else the text."""
    parts = F.transform(F.split(text, H.INLINE_NUMBER, -1), lambda x: _trimmed(F.regexp_replace(_trimmed(x), "[;；]+$", "")))
    parts = F.filter(parts, lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(text))


def without_label(text: Column, purpose: Column, kind: Column) -> Column:
    label = F.upper(F.regexp_extract(text, H.STATEMENT_LABEL, 1))
    fits = reduce(lambda x, p: F.when(purpose == p[0], label.isin(*p[1])).otherwise(x), H.LABELS.items(), label.isin(*H.LABELS["implementation"]))
    own = F.when(fits, F.regexp_replace(text, H.STATEMENT_LABEL, "")).otherwise(text)
    return F.when(kind.isNotNull(), F.regexp_replace(text, H.TRANSFORMATION_LABEL, "")).otherwise(own)


def _looked_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key)


def _section(title: Column, above: Column) -> Column:
    name = heading_name(title)
    kind = F.coalesce(_looked_up({"\n".join(pair): kind for pair, kind in H.BELOW.items()}, F.concat_ws("\n", above, name)), _looked_up(H.TRANSFORMATIONS, name))
    role, purpose = (F.when(kind.isNull(), _looked_up({h: m[i] for h, m in H.SECTIONS.items()}, name)) for i in (0, 1))
    return F.struct(cleaned(title).alias("title"), role.alias("role"), purpose.alias("purpose"), kind.alias("kind")).cast(SECTION)


def marked_lines(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, raw, sort (heading, item, blank, text, fence), section, headings, block and item_no of every line that isn't fenced."""
    lines = bodies.select(*keys, F.posexplode(F.split("body", H.LINE_END, -1)).alias("n", "raw")).withColumn("n", F.col("n") + 1)
    order = Window.partitionBy(*keys).orderBy("n")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("mark", F.nullif(F.substring(F.regexp_extract("raw", H.FENCE, 1), 1, 1), F.lit("")))
    last_mark = F.last("mark", ignorenulls=True).over(before)
    lines = lines.withColumn("turn", F.when(F.col("mark").isNotNull() & ~last_mark.eqNullSafe(F.col("mark")), 1).otherwise(0))
    lines = lines.withColumn("run", F.sum("turn").over(upto))
    in_run = Window.partitionBy(*keys, "run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("fenced", F.col("mark").isNull() & (F.count("mark").over(in_run) % 2 == 1)).where("not fenced")
    kinds = [(F.col("mark").isNotNull(), "fence"), (F.col("raw").rlike(H.HEADING), "heading"), (F.col("raw").rlike(H.LIST_ITEM), "item"), (_trimmed(F.col("raw")) == "", "blank")]
    lines = lines.withColumn("sort", F.coalesce(*[F.when(test, F.lit(name)) for test, name in kinds], F.lit("text")))
    is_heading = F.col("sort") == "heading"
    lines = lines.withColumn("title", F.when(is_heading, F.regexp_extract("raw", H.HEADING, 1)))
    lines = lines.withColumn("level", F.when(is_heading, F.length("raw") - F.length(F.ltrim("raw", F.lit("#")))))
    lines = lines.withColumn("name", heading_name(F.col("title")))
    # the heading above one of a level: the last one of any lesser level
    above = F.coalesce(*[F.when(F.col("level") == k, F.last(F.when(F.col("level") < k, F.col("name")), ignorenulls=True).over(before)) for k in range(1, 7)], F.lit(""))
    lines = lines.withColumn("above", above).withColumn("own", F.when(is_heading, _section(F.col("title"), F.col("above"))))
    lines = lines.withColumn("section", F.last("own", ignorenulls=True).over(upto)).withColumn("headings", F.count("own").over(upto))
    lines = lines.withColumn("block", F.count(F.when(F.col("sort").isin("heading", "fence", "blank"), 1)).over(upto))
    in_block = Window.partitionBy(*keys, "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("item_no", F.count(F.when(F.col("sort") == "item", 1)).over(in_block))
    # the introduction goes on to the first empty line behind its beginning
    lines = lines.withColumn("begun", F.count(F.when((F.col("sort") == "text") & (F.col("headings") == 0), 1)).over(before) > 0)
    over = F.count(F.when((F.col("sort") == "blank") & F.col("begun"), 1)).over(upto) > 0
    lines = lines.withColumn("intro", (F.col("sort") == "text") & (F.col("headings") == 0) & ~over)
    return lines.select(*keys, "n", "raw", "sort", "section", "block", "item_no", "intro")


def _groups(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, item_no, intro, section, line, indent and text of the introduction, each paragraph and each item with the lines behind it."""
    opened = F.col("section.kind").isNotNull() | F.col("section.role").isNotNull()
    says = F.col("section.kind").isNotNull() | F.col("section.role").isin(*PARAGRAPH_ROLES)
    used = lines.where(F.col("sort").isin("item", "text")).where(F.col("intro") | (opened & ((F.col("item_no") > 0) | says)))
    is_item = F.col("sort") == "item"
    piece = F.when(is_item, without_label(F.regexp_extract("raw", H.LIST_ITEM, 2), F.col("section.purpose"), F.col("section.kind"))).otherwise(_trimmed(F.col("raw")))
    white = F.regexp_extract("raw", H.LIST_ITEM, 1)
    used = used.withColumn("piece", F.struct("n", piece.alias("text"))).withColumn("own_indent", F.when(is_item, F.length(white) + 3 * F.regexp_count(white, F.lit("\t"))))
    # the introduction is one group, whatever blocks its lines are in
    block, item = (F.when(F.col("intro"), F.lit(-1)).otherwise(F.col(c)).alias(c) for c in ("block", "item_no"))
    grouped = used.groupBy(*keys, block, item, "intro").agg(
        F.first("section").alias("section"), F.min("n").alias("line"), F.max("own_indent").alias("indent"), F.sort_array(F.collect_list("piece")).alias("pieces")
    )
    return grouped.withColumn("text", F.array_join(F.transform("pieces", lambda p: p["text"]), " ")).drop("pieces")


def _item_texts(items: DataFrame, keys: list[str]) -> DataFrame:
    """items that have no children, with their parents' texts before their own."""
    own = [*keys, "block"]
    order = Window.partitionBy(*own).orderBy("item_no")
    items = items.withColumn("indents", F.collect_set("indent").over(Window.partitionBy(*own)))
    items = items.withColumn("childless", ~F.coalesce(F.lead("indent").over(order) > F.col("indent"), F.lit(False)))
    # for each lesser indent of the block: the last item before that is no deeper is a parent if it has this indent
    steps = items.select(*own, "item_no", "text", "indent", F.explode(F.filter("indents", lambda v: v >= F.col("indent"))).alias("depth"), F.lit(False).alias("asks"))
    asks = items.where("childless").select(*own, "item_no", "text", "indent", F.explode(F.filter("indents", lambda v: v < F.col("indent"))).alias("depth"), F.lit(True).alias("asks"))
    along = Window.partitionBy(*own, "depth").orderBy("item_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = steps.union(asks).withColumn("last", F.last(F.when(~F.col("asks"), F.struct("indent", "text")), ignorenulls=True).over(along))
    parents = seen.where("asks and last.indent = depth").groupBy(*own, "item_no").agg(F.sort_array(F.collect_list(F.struct("depth", F.col("last.text").alias("text")))).alias("parents"))
    joined = items.where("childless").join(parents, [*own, "item_no"], "left")
    whole = F.array_join(F.concat(F.coalesce(F.transform("parents", lambda p: p["text"]), F.array().cast("array<string>")), F.array("text")), ": ")
    return joined.withColumn("text", whole)


def statements(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, text, raw, role, purpose, kind, section and line of each statement of bodies (body); the introduction is the row of role intent."""
    groups = _groups(marked_lines(bodies, keys), keys)
    columns = [*keys, "intro", "section", "line"]
    plain = groups.where("intro or item_no = 0").select(*columns, F.lit(0).alias("part"), F.col("text").alias("raw"))
    items = _item_texts(groups.where("item_no > 0"), keys).select(*columns, F.posexplode(numbered_parts(F.col("text"))).alias("part", "raw"))
    found = plain.union(items).withColumn("text", cleaned(F.col("raw"))).where("text <> ''")
    role, purpose = (F.when(F.col("intro"), "intent").otherwise(F.col(f"section.{c}")).alias(c) for c in ("role", "purpose"))
    found = found.select(*keys, "intro", "part", "text", F.when(F.col("intro"), F.col("text")).otherwise(F.col("raw")).alias("raw"), role, purpose, F.when(~F.col("intro"), F.col("section.kind")).alias("kind"), F.when(F.col("intro"), "").otherwise(F.col("section.title")).alias("section"), "line")
    alike = Window.partitionBy(*keys, "intro", "role", "purpose", "kind", F.lower("text")).orderBy("line", "part")
    found = found.withColumn("again", F.row_number().over(alike)).where("again = 1")
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("intro").desc(), "line", "part")) - 1
    return found.select(*keys, ordinal.alias("ordinal"), "text", "raw", "role", "purpose", "kind", "section", "line")
