"""Chat formatting as relational steps: turns are sorted structs, adjacent turns of a role are one block, text is joined by expressions.

A block is `<turn ROLE>`, a line feed, its turns' texts with `<turn+>` between them, `</turn>` and a line feed. In
texts and roles `\\` becomes `\\\\`, and the `<` of `<turn` or `</turn` becomes `\\l`; in roles `>` becomes `\\g` too. So
no text holds a control string, and splitting at control strings and undoing the escapes gives the rows back.

The loss mask is a list of spans (start, length in code points of the formatted text): the texts of assistant turns.

Null texts and roles count as empty, null turns come first, rows of one turn are ordered by role and text and all kept;
rows without conv_id are one conversation. An empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
OPEN, NEXT, CLOSE = "<turn ", "<turn+>", "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    pairs = [("\\", "\\\\"), ("</turn", "\\l/turn"), ("<turn", "\\lturn")] + [(">", "\\g")] * role
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescaped(text: Column) -> Column:
    """Undo escaped(); pairs of backslashes are set apart first, so that the second never begins another escape."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(plain, "\\")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted (string), n_turns, n_blocks and loss_spans for every conversation (conv_id, turn, role, text).

    What stands before and after a turn, and where it begins, are windows over the rows, so work grows with the turns.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"))
    rows = rows.withColumn("n", F.row_number().over(order))
    by_place = Window.partitionBy("conv_id").orderBy("n")
    apart = lambda other: F.coalesce(other.over(by_place) != F.col("role"), F.lit(True))
    rows = rows.select("conv_id", "n", escaped(F.col("role"), True).alias("role"), escaped(F.col("text")).alias("text"), apart(F.lag("role")).alias("opens"), apart(F.lead("role")).alias("closes"))
    mark = F.when(F.col("opens"), F.concat(F.lit(OPEN), "role", F.lit(">\n"))).otherwise(F.lit(NEXT))
    end = F.when(F.col("closes"), F.lit(CLOSE)).otherwise(F.lit(""))
    rows = rows.select("conv_id", "n", "role", "opens", F.length(mark).alias("ahead"), F.length("text").alias("size"), F.concat(mark, "text", end).alias("piece"))
    before = F.coalesce(F.sum(F.length("piece")).over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("role") == LOSS_ROLE, F.struct((before + F.col("ahead")).cast("long").alias("start"), F.col("size").cast("long").alias("length")))
    held = rows.withColumn("span", span).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "span"))).alias("pieces"), F.count("*").alias("n_turns"), F.count_if("opens").alias("n_blocks"))
    spans = F.transform(F.filter("pieces", lambda p: p["span"].isNotNull()), lambda p: p["span"])
    return held.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "n_turns", "n_blocks", spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text and formatted_chars, read back from formatted and loss_spans alone.

    Blocks and texts become rows, whose places are sums over them; the loss is the texts that begin and end where a span does.
    """
    # what goes along with exploded rows is made before, so that no row carries the whole
    split = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "").alias("blocks"))
    blocks = split.select("conv_id", "formatted_chars", F.posexplode("blocks").alias("block", "b"))
    begins = F.instr("b", ">\n")
    blocks = blocks.select("conv_id", "formatted_chars", "block", F.substring("b", F.lit(len(OPEN) + 1), begins - len(OPEN) - 1).alias("role"), F.split(F.substring("b", begins + 2, F.length("b")), r"<turn\+>", -1).alias("texts"))
    rows = blocks.withColumn("n_texts", F.size("texts")).select("conv_id", "formatted_chars", "block", "role", "n_texts", F.posexplode("texts").alias("at", "text"))
    ahead = F.when(F.col("at") == 0, F.length("role") + len(OPEN) + 2).otherwise(F.lit(len(NEXT)))
    behind = F.when(F.col("at") == F.col("n_texts") - 1, F.lit(len(CLOSE))).otherwise(F.lit(0))
    upto = Window.partitionBy("conv_id").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(ahead + F.length("text") + behind).over(upto), F.lit(0)) + ahead).cast("long")
    rows = rows.withColumn("start", start).withColumn("length", F.length("text").cast("long"))
    spans = formatted.select(F.col("conv_id").alias("_conv"), F.inline("loss_spans")).toDF("_conv", "_start", "_length").withColumn("loss", F.lit(True))
    met = rows.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("start") == F.col("_start")) & (F.col("length") == F.col("_length")), "left")
    turn = F.struct("block", "at", unescaped(F.col("role")).alias("role"), unescaped(F.col("text")).alias("text"), F.coalesce("loss", F.lit(False)).alias("loss"))
    held = met.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"), F.max("formatted_chars").alias("formatted_chars"))
    turns = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    loss = F.array_join(F.transform(F.filter("t", lambda t: t["loss"]), lambda t: t["text"]), "")
    return held.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted_chars")
