"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

The tree's levels are domain, language and source. A node's budget goes to its children by their weights; a child
never gets more than its leaves hold in EPOCHS passes, and what it can't take goes to its siblings by their weights.
As every node's own budget is what it can hold, shortages move to the level above only when all siblings are full.
The shares have a closed form: with children by capacity / weight, the full ones come first. Leaves below any node of
weight 0 hold nothing.

Each pass over a leaf is an epoch with an order of its own: the md5 of seed, epoch and doc_id. A leaf's budget of
tokens takes whole epochs, then the next one's prefix: documents as long as the tokens up to and with them fit. Sums
along an epoch are first taken by the first three hex digits (at most 4096 for a leaf), so only the digits at which a
leaf's budget ends need the order of their own documents. So a leaf comes down to its number of whole epochs and the
last digest of the part; with these, rows are judged one by one, and texts are never shuffled.

Tokens are words between ASCII white space. Null texts have none; null languages and sources are a leaf of their own;
documents without tokens are in every epoch whose prefix comes to them; a leaf's rows of one doc_id are ordered as one
and all taken or left; rows of one doc_id in two leaves are judged by their own leaf. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import checkpointed, fresh, maybe_broadcast

SEED, EPOCHS, SHARE = 42, 2, 0.8
WORD = r"[^\x20\x09-\x0D]+"
#: Domains of sources: by the first hex digit of the source's md5.
DOMAINS = (("web", "01234567"), ("books", "89ab"), ("forums", "cdef"))
#: Weights of nodes by their paths: (domain,), (domain, language) or (domain, language, source). Nodes that aren't named
#: weigh 1, domains that aren't named 0 where any domain is.
WEIGHTS = {("web",): 0.5, ("books",): 0.3, ("forums",): 0.2}
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    digit = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)
    return F.coalesce(*[F.when(digit.isin(*digits), F.lit(name)) for name, digits in DOMAINS])


def weighted(leaves: DataFrame, weights: dict[tuple, float]) -> DataFrame:
    """leaves (domain, lang, source) with domain_weight, lang_weight and source_weight."""
    spark = leaves.sparkSession
    for depth, level in enumerate(LEVELS, 1):
        own = [(*path, float(w)) for path, w in weights.items() if len(path) == depth]
        other = 0.0 if depth == 1 and own else 1.0
        keys = [f"_{c}" for c in LEVELS[:depth]]
        table = spark.createDataFrame(own, ", ".join(f"{k} string" for k in keys) + ", _weight double")
        on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(LEVELS, keys)]
        leaves = leaves.join(maybe_broadcast(table, len(own)), on, "left").withColumn(f"{level}_weight", F.coalesce("_weight", F.lit(other))).drop(*keys, "_weight")
    return leaves


def _poured(nodes: DataFrame, parent: list[str], budget: str, weight: str, capacity: str, out: str) -> DataFrame:
    """nodes with out: each parent's budget by weight, no node over its capacity, the rest to its siblings."""
    ratio = F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy(F.col("_ratio"), *[c for c in ("domain", "lang", "source") if c in nodes.columns])
    whole = Window.partitionBy(*parent)
    nodes = nodes.withColumn("_ratio", ratio)
    nodes = nodes.withColumn("_before", F.coalesce(F.sum(capacity).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("_rest", F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing)))
    nodes = nodes.withColumn("_full", (F.col(weight) > 0) & (F.col("_before") + F.col("_ratio") * F.col("_rest") <= F.col(budget)))
    nodes = nodes.withColumn("_left", F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col(capacity))).over(whole), F.lit(0)))
    nodes = nodes.withColumn("_open", F.sum(F.when(~F.col("_full"), F.col(weight))).over(whole))
    share = F.when(F.col("_full"), F.col(capacity)).when(F.col(weight) > 0, F.col("_left") * F.col(weight) / F.col("_open")).otherwise(0.0)
    return nodes.withColumn(out, share.cast("double")).drop("_ratio", "_before", "_rest", "_full", "_left", "_open")


def leaf_budgets(counted: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: dict[tuple, float] = WEIGHTS) -> DataFrame:
    """domain, lang, source, tokens and budget (whole tokens) for every leaf of counted (domain, lang, source, tokens).

    The whole budget is that share of all tokens, or what leaves of weight above 0 can hold if that is less.
    """
    leaves = weighted(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), weights)
    able = (F.col("domain_weight") > 0) & (F.col("lang_weight") > 0) & (F.col("source_weight") > 0)
    leaves = checkpointed(leaves.withColumn("room", F.when(able, F.col("tokens") * epochs).otherwise(0)))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("room").alias("room"), F.max("domain_weight").alias("domain_weight"), F.max("lang_weight").alias("lang_weight"))
    domains = langs.groupBy("domain").agg(F.sum("room").alias("room"), F.max("domain_weight").alias("domain_weight"))
    total = leaves.agg(F.least(F.floor(F.sum("tokens") * F.lit(share)), F.sum("room")).alias("all_tokens"))
    domains = domains.crossJoin(F.broadcast(total)).withColumn("root", F.lit(0))  # one row
    domains = _poured(domains, ["root"], "all_tokens", "domain_weight", "room", "domain_budget").select("domain", "domain_budget")
    langs = _poured(langs.join(domains, "domain"), ["domain"], "domain_budget", "lang_weight", "room", "lang_budget").select(F.col("domain").alias("d"), F.col("lang").alias("l"), "lang_budget")
    joined = leaves.join(langs, (F.col("domain") == F.col("d")) & F.col("lang").eqNullSafe(F.col("l")))
    poured = _poured(joined, ["d", "l"], "lang_budget", "source_weight", "room", "own_budget")
    return poured.select(*LEVELS, "tokens", F.floor(F.col("own_budget") + 1e-6).cast("long").alias("budget"))


def _digest(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))).cast("binary"))


def _leaf(domain: Column, lang: Column, source: Column) -> Column:
    return F.xxhash64(domain, lang, source, domain.isNull(), lang.isNull(), source.isNull())


def _tree(docs: DataFrame, domain: Column | None) -> tuple[Column, Column, Column]:
    return (domain_of(docs["source"]) if domain is None else domain).cast("string"), docs["lang"].cast("string"), docs["source"].cast("string")


def leaf_cuts(counted: DataFrame, share: float, epochs: int, weights: dict[tuple, float], seed: int) -> tuple[DataFrame, int]:
    """leaf, whole_epochs and last_digest (of the epoch after these; null if it has no part) for every leaf, and how many there are.

    counted: doc_id, domain, lang, source, tokens.
    """
    leaves = checkpointed(leaf_budgets(counted, share, epochs, weights))
    count = leaves.count()
    # of a leaf without tokens every document is taken once
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int")
    small = checkpointed(leaves.select(_leaf(*map(F.col, LEVELS)).alias("leaf"), whole.alias("whole_epochs"), (F.col("budget") - whole * F.col("tokens")).alias("left")))
    open_leaves = small.where(f"left > 0 and whole_epochs < {epochs}")
    rows = counted.withColumn("own", _leaf(*map(F.col, LEVELS))).join(maybe_broadcast(open_leaves, count), F.col("own") == F.col("leaf"))
    rows = rows.select("leaf", "left", "tokens", _digest(F.col("whole_epochs"), F.col("doc_id"), seed).alias("digest")).withColumn("bin", F.substring("digest", 1, 3))
    sums = rows.groupBy("leaf", "bin").agg(F.sum("tokens").alias("bin_tokens"), F.max("left").alias("left"))
    along = Window.partitionBy("leaf").orderBy("bin")  # at most 4096 rows
    sums = checkpointed(sums.withColumn("upto", F.sum("bin_tokens").over(along)))
    # the first bin that the budget doesn't take whole; as the leaf has more tokens than are left there is one
    ends = sums.where("upto > left").groupBy("leaf").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_tokens")).alias("before"))).alias("end"))
    ends = checkpointed(ends.select(F.col("leaf").alias("end_leaf"), F.col("end")["bin"].alias("end_bin"), F.col("end")["before"].alias("before")))
    within = Window.partitionBy("leaf").orderBy("digest").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.join(maybe_broadcast(ends, count), (F.col("leaf") == F.col("end_leaf")) & (F.col("bin") == F.col("end_bin")))
    # rows of one digest are one step, however many they are
    last = last.groupBy("leaf", "digest").agg(F.sum("tokens").alias("tokens"), F.max("before").alias("before"), F.max("left").alias("left"))
    last = last.withColumn("upto", F.col("before") + F.sum("tokens").over(within)).where("upto <= left").groupBy("leaf").agg(F.max("digest").alias("digest"))
    cuts = small.join(ends, F.col("leaf") == F.col("end_leaf"), "left").join(last.withColumnRenamed("leaf", "last_leaf"), F.col("leaf") == F.col("last_leaf"), "left")
    # bins before the end bin are whole: a digest that begins with the end bin's digits and nothing else comes after all of theirs
    return checkpointed(cuts.select("leaf", "whole_epochs", F.coalesce("digest", "end_bin").alias("last_digest"))), count


def _taken(rows: DataFrame, cuts: DataFrame, count: int, leaf: Column, doc_id: Column, seed: int, name: str) -> DataFrame:
    """rows with a column of how many epochs take them; those that none takes are gone."""
    own = cuts.toDF(*[f"{name}_{c}" for c in cuts.columns])
    key, whole, last = (own[c] for c in own.columns)
    part = F.coalesce(_digest(whole, doc_id, seed) <= last, F.lit(False)).cast("int")
    joined = rows.join(maybe_broadcast(own, count), leaf == key)
    return joined.withColumn(name, whole + part).where(F.col(name) > 0).drop(*own.columns)


def mixed_ids(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights: dict[tuple, float] = WEIGHTS, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, epoch and n_tokens for every row of docs and epoch that the budgets take."""
    counted = checkpointed(_counted(docs, domain))
    cuts, count = leaf_cuts(counted, share, epochs, weights, seed)
    taken = _taken(counted, cuts, count, _leaf(*map(F.col, LEVELS)), F.col("doc_id"), seed, "times")
    return taken.select("doc_id", *LEVELS, F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"), F.col("tokens").alias("n_tokens"))


def _counted(docs: DataFrame, domain: Column | None) -> DataFrame:
    tree = [c.alias(n) for c, n in zip(_tree(docs, domain), LEVELS)]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), *tree, F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights: dict[tuple, float] = WEIGHTS, domain: Column | None = None) -> DataFrame:
    """Rows of docs that the budgets take, once for each epoch that takes them; domain: an expression over docs."""
    cuts, count = leaf_cuts(checkpointed(_counted(docs, domain)), share, epochs, weights, seed)
    name = fresh(docs, "_times")
    rows = _taken(docs, cuts, count, _leaf(*_tree(docs, domain)), docs["doc_id"], seed, name)
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))).select(*docs.columns)
