"""Graphs of symbols: bounded paths, ownership, backbones, groups lifted to common owners, and roll-ups to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.stages import kept

# What limits a seed, in the order it is told.
LIMITS = ("seed_node_budget", "seed_path_budget", "review_node_budget", "review_path_budget")
# Bounds of traversals, and the relations they follow.
PATH_DEPTH, SEED_NODES, SEED_PATHS, REVIEW_NODES, REVIEW_PATHS = 3, 80, 120, 80, 120
OWNERSHIP_DEPTH, OWNERSHIP_RELATIONS = 8, 240
RELATIONS = ("calls", "imports", "instantiates", "references", "extends")


def bounded_paths(edges: DataFrame, seeds: DataFrame, depth: int = PATH_DEPTH) -> DataFrame:
    """seed, depth and nodes (array) of every simple path of at most so many edges, along edges either way.

    edges: source, target; seeds: seed. A join for each hop; a path's own nodes are never met again. No budgets.
    """
    both = edges.select("source", "target").union(edges.select("target", "source")).distinct().toDF("at", "next")
    level = seeds.select("seed", F.array("seed").alias("nodes"), F.col("seed").alias("at"))
    out = None
    for k in range(1, depth + 1):
        level = level.join(both, "at").where(~F.array_contains("nodes", F.col("next"))).select("seed", F.concat("nodes", F.array("next")).alias("nodes"), F.col("next").alias("at"))
        found = level.select("seed", F.lit(k).alias("depth"), "nodes")
        out = found if out is None else out.union(found)
    return out


def _took_turns(level: DataFrame, key: list[str]) -> DataFrame:
    """Candidates (key, seed, seed_order, at, node, is_own: the seed has it already, spare: nodes that it may still add) with
    turn: which turn of their seed they take, null for those that its full node budget skips; n_before: turns before theirs."""
    seed = Window.partitionBy(*key, "seed")
    first = F.row_number().over(Window.partitionBy(*key, "seed", "node").orderBy("at")) == 1
    level = level.withColumn("is_first", first & ~F.col("is_own"))
    # the place of a node among those that are new to the seed; all of a node's candidates share it
    upto = seed.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = level.withColumn("new_place", F.sum(F.col("is_first").cast("int")).over(upto))
    level = level.withColumn("new_place", F.when(F.col("is_own"), 0).otherwise(F.min(F.when(F.col("is_first"), F.col("new_place"))).over(Window.partitionBy(*key, "seed", "node"))))
    level = level.withColumn("fits", F.col("new_place") <= F.col("spare"))
    count = F.sum(F.col("fits").cast("int")).over(upto)
    return level.withColumn("turn", F.when(F.col("fits"), count)).withColumn("n_before", count - F.col("fits").cast("int")).drop("new_place")


def budgeted_paths(edges: DataFrame, seeds: DataFrame, review: str = "review_id", policy: tuple = (PATH_DEPTH, SEED_NODES, SEED_PATHS, REVIEW_NODES, REVIEW_PATHS)) -> DataFrame:
    """Paths and seed states of the fair, budgeted traversal.

    edges: review, source, target, relation, order (of a node's neighbours); seeds: review, seed, order. Depth by depth the
    seeds take turns, a path each, until a whole round gives none. A seed's candidates of a depth are one join of its paths
    with the edges; their order gives turns, turns of all seeds the review's order. Budgets are cuts of these orders, since
    none is given back: a seed adds its first so many nodes; once the review is full, its later candidates are those that lead
    to nodes it has met, and they are dealt anew from there. So a depth is a few windows, by seed and then by review over
    what the seeds' path budgets leave. Rows: kind (path or state), seed, ordinal, nodes, relations, detail.
    """
    depth, seed_nodes, seed_paths, review_nodes, review_paths = policy
    key = [review]
    edges = edges.select(F.col(review).cast("string").alias(review), "source", "target", "relation", F.col("order").cast("long").alias("order"))
    # a node's neighbours in the order of the edges; an edge serves both of its ends
    both = edges.select(review, F.col("source").alias("end"), F.col("target").alias("node"), "relation", "order", "source", "target", F.lit(0).alias("back"))
    both = both.union(edges.select(review, F.col("target").alias("end"), F.col("source").alias("node"), "relation", "order", "source", "target", F.lit(1).alias("back")))
    named = seeds.select(F.col(review).cast("string").alias(review), "seed", F.col("order").cast("long").alias("order")).groupBy(review, "seed").agg(F.min("order").alias("order"))
    named = kept(named.withColumn("seed_order", F.row_number().over(Window.partitionBy(review).orderBy("order", "seed"))).drop("order"))
    own = named.select(review, "seed", F.col("seed").alias("node"))
    frontier = named.select(review, "seed", "seed_order", F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("relations"), F.col("seed").alias("end"), F.lit(1).cast("long").alias("place"))
    # of each seed: paths so far, done (its path budget ended it); limits as they come
    state = named.select(review, "seed", "seed_order", F.lit(0).cast("long").alias("n_paths"), F.lit(False).alias("done"))
    total = named.groupBy(review).agg(F.lit(0).cast("long").alias("n_all"), F.count("*").alias("n_met"))
    met = named.select(review, F.col("seed").alias("node"))
    found = limits = None
    for k in range(1, depth + 1):
        open_ = frontier.join(state.where("not done").select(review, "seed", "n_paths"), [review, "seed"]).join(total.where(F.col("n_all") < review_paths), review)
        level = open_.join(both, [review, "end"]).where(~F.array_contains("nodes", F.col("node")))
        at = F.row_number().over(Window.partitionBy(review, "seed").orderBy("place", "order", "source", "target", "relation", "back"))
        level = level.select(review, "seed", "seed_order", "n_paths", "n_all", "n_met", F.concat("nodes", F.array("node")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"), "node", at.alias("at"))
        level = level.join(own.withColumn("is_own", F.lit(True)), [review, "seed", "node"], "left").join(met.withColumn("is_met", F.lit(True)), [review, "node"], "left")
        sizes = own.groupBy(review, "seed").agg((seed_nodes - F.count("*")).alias("spare"))
        level = kept(level.join(sizes, [review, "seed"]).na.fill(False, ["is_own", "is_met"]))
        # as if the review had room for every node; then the turn at which it is full
        first = _took_turns(level, key)
        usable = first.where(F.col("turn").isNotNull() & (F.col("n_paths") + F.col("turn") <= seed_paths))
        new = usable.where("not is_met").groupBy(review, "node").agg(F.min(F.struct("turn", "seed_order")).alias("met_at"), F.first("n_met").alias("n_met"))
        new = new.withColumn("n", F.row_number().over(Window.partitionBy(review).orderBy("met_at")))
        full = new.groupBy(review).agg(F.min(F.when(F.col("n") == review_nodes - F.col("n_met"), F.col("met_at"))).alias("full_at"))
        full = total.select(review, F.when(F.col("n_met") >= review_nodes, F.struct(F.lit(0).alias("turn"), F.lit(0).alias("seed_order"))).alias("was_full")).join(full, review, "left").select(review, F.coalesce("was_full", "full_at").alias("full_at"))
        full = full.where("full_at is not null")
        has = met.union(new.where(F.col("n") <= review_nodes - F.col("n_met")).select(review, "node")).distinct()
        first = first.join(full, review, "left")
        here = F.struct(F.col("turn").alias("turn"), F.col("seed_order").alias("seed_order"))
        # a candidate comes before the review is full if the turn that it is looked at in does
        seen = F.struct((F.col("n_before") + 1).alias("turn"), F.col("seed_order").alias("seed_order"))
        first = first.withColumn("early", F.col("full_at").isNull() | (seen <= F.struct(F.col("full_at.turn").alias("turn"), F.col("full_at.seed_order").alias("seed_order"))))
        early = first.where("early")
        late = first.where("not early").select(*level.columns)
        taken = early.where(F.col("turn").isNotNull())
        held = taken.groupBy(review, "seed").agg(F.max("turn").alias("n_early"))
        gained = taken.where("not is_own").select(review, "seed", "node").distinct()
        grown = gained.groupBy(review, "seed").agg(F.count("*").alias("n_gained"))
        late = late.drop("is_own", "is_met").join(own.union(gained).withColumn("is_own", F.lit(True)), [review, "seed", "node"], "left").join(has.withColumn("is_met", F.lit(True)), [review, "node"], "left")
        late = late.join(held, [review, "seed"], "left").join(grown, [review, "seed"], "left").na.fill(0, ["n_early", "n_gained"]).na.fill(False, ["is_own", "is_met"]).withColumn("spare", F.col("spare") - F.col("n_gained"))
        dealt = _took_turns(late.where("is_met"), key)
        strays = late.where("not is_met")
        columns = [review, "seed", "seed_order", "n_paths", "n_all", "nodes", "relations", "node", "at"]
        rows = early.select(*columns, "turn", "n_before", F.lit("seed_node_budget").alias("skipped"))
        rows = rows.unionByName(dealt.select(*columns, (F.col("turn") + F.col("n_early")).alias("turn"), (F.col("n_before") + F.col("n_early")).alias("n_before"), F.lit("seed_node_budget").alias("skipped")))
        # a stray is looked at between the seed's own turns; with a full seed its own budget is what skips it
        around = dealt.select(review, "seed", "at", "turn", F.lit(None).cast("long").alias("n_own"), F.col("is_first").cast("int").alias("adds"), F.lit(False).alias("stray"), "n_early", "spare", "seed_order", "n_paths", "n_all", "nodes", "relations", "node", "fits")
        around = around.unionByName(strays.select(review, "seed", "at", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("n_own"), F.lit(0).alias("adds"), F.lit(True).alias("stray"), "n_early", "spare", "seed_order", "n_paths", "n_all", "nodes", "relations", "node", F.lit(False).alias("fits")))
        upto = Window.partitionBy(review, "seed").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        around = around.withColumn("b", F.coalesce(F.sum(F.col("fits").cast("int")).over(upto), F.lit(0))).withColumn("a", F.coalesce(F.sum("adds").over(upto), F.lit(0))).where("stray")
        rows = rows.unionByName(around.select(*columns, "turn", (F.col("b") + F.col("n_early")).alias("n_before"), F.when(F.col("a") >= F.col("spare"), "seed_node_budget").otherwise("review_node_budget").alias("skipped")))
        rows = kept(rows)
        # a seed ends when it looks at a candidate with its path budget spent; the review when its budget is
        going = rows.where(F.col("turn").isNotNull() & (F.col("n_paths") + F.col("turn") <= seed_paths))
        going = going.withColumn("ordinal", F.col("n_all") + F.row_number().over(Window.partitionBy(review).orderBy("turn", "seed_order")))
        going = kept(going.where(F.col("ordinal") <= review_paths))
        ends = going.where(F.col("ordinal") == review_paths).select(review, here.alias("ended_at"))
        looked = rows.join(ends, review, "left").where(F.col("ended_at").isNull() | (seen <= F.struct(F.col("ended_at.turn").alias("turn"), F.col("ended_at.seed_order").alias("seed_order"))))
        over = F.col("n_paths") + F.col("n_before") >= seed_paths
        told = looked.select(review, "seed", F.when(over, "seed_path_budget").when(F.col("turn").isNull(), F.col("skipped")).alias("limit"), over.alias("over")).where("limit is not null").distinct()
        limits = told.select(review, "seed", "limit") if limits is None else limits.union(told.select(review, "seed", "limit"))
        paths = going.select(review, "seed", "seed_order", "nodes", "relations", "ordinal", "node", "turn")
        found = paths if found is None else found.union(paths)
        spent = told.where("over").select(review, "seed").distinct().withColumn("now_done", F.lit(True))
        added = going.groupBy(review, "seed").agg(F.count("*").alias("n"))
        state = kept(state.join(added, [review, "seed"], "left").join(spent, [review, "seed"], "left").select(review, "seed", "seed_order", (F.col("n_paths") + F.coalesce("n", F.lit(0))).alias("n_paths"), (F.col("done") | F.coalesce("now_done", F.lit(False))).alias("done")))
        own = own.union(going.select(review, "seed", "node")).distinct()
        met = own.select(review, "node").distinct()
        total = state.groupBy(review).agg(F.sum("n_paths").alias("n_all")).join(met.groupBy(review).agg(F.count("*").alias("n_met")), review)
        frontier = going.select(review, "seed", "seed_order", "nodes", "relations", F.col("node").alias("end"), F.col("turn").alias("place"))
    cut = state.where("not done").join(total.where(F.col("n_all") >= review_paths), review).select(review, "seed", F.lit("review_path_budget").alias("limit"))
    places = F.array(*map(F.lit, LIMITS))
    told = limits.union(cut).groupBy(review, "seed").agg(F.array_sort(F.collect_set(F.array_position(places, F.col("limit")))).alias("limits"))
    detail = F.when(F.col("limits").isNull(), F.array(F.lit("complete"))).otherwise(F.concat(F.array(F.lit("truncated")), F.transform("limits", lambda i: F.element_at(places, i.cast("int")))))
    none = F.array().cast("array<string>")
    states = named.join(told, [review, "seed"], "left").select(review, F.lit("state").alias("kind"), "seed", (F.col("seed_order") - 1).cast("int").alias("ordinal"), none.alias("nodes"), none.alias("relations"), detail.alias("detail"))
    return found.select(review, F.lit("path").alias("kind"), "seed", (F.col("ordinal") - 1).cast("int").alias("ordinal"), "nodes", "relations", none.alias("detail")).union(states)


def ownership_chains(parents: DataFrame, keys: tuple[str, ...] = ("review_id",)) -> tuple[DataFrame, DataFrame]:
    """keys, node and chain (from the root to the node) of every node, and the nodes below or on a cycle, which have none.

    parents: keys, child, parent; one parent for each child. Chains double: each round a node's chain goes on with its top's
    chain, so a chain of n owners takes log2(n) joins and its length is never bounded.
    """
    keys = list(keys)
    own = parents.select(*keys, F.col("child").alias("node"), "parent")
    roots = own.select(*keys, F.col("parent").alias("node")).distinct().join(own.select(*keys, "node"), [*keys, "node"], "left_anti")
    state = kept(own.select(*keys, "node", F.array("node", "parent").alias("chain"), F.col("parent").alias("top")).union(roots.select(*keys, "node", F.array("node"), F.lit(None).cast(own.schema["parent"].dataType))))
    done, open_ = state.where("top is null"), state.where("top is not null")
    while not open_.isEmpty():
        above = state.select(*keys, F.col("node").alias("top"), F.col("chain").alias("upper"), F.col("top").alias("next"))
        longer = open_.join(above, [*keys, "top"]).select(*keys, "node", F.concat("chain", F.slice("upper", F.lit(2), F.size("upper"))).alias("chain"), F.col("next").alias("top"))
        state = kept(done.union(longer.withColumn("top", F.when(F.size(F.array_distinct("chain")) == F.size("chain"), F.col("top")))))
        done, open_ = state.where("top is null"), state.where("top is not null")
    whole = F.size(F.array_distinct("chain")) == F.size("chain")
    return state.where(whole).select(*keys, "node", F.reverse("chain").alias("chain")), state.where(~whole).select(*keys, "node")


def ancestors(parents: DataFrame, starts: DataFrame, depth: int = OWNERSHIP_DEPTH) -> DataFrame:
    """node, ancestor and level of all owners up to a depth; a chain that comes back to its own nodes ends there.

    parents: child, parent; starts: node.
    """
    own = parents.select(F.col("child").alias("top"), "parent").distinct()
    level = starts.select("node", F.array("node").alias("chain"), F.col("node").alias("top")).distinct()
    out = None
    for k in range(1, depth + 1):
        level = level.join(own, "top").where(~F.array_contains("chain", F.col("parent"))).select("node", F.concat("chain", F.array("parent")).alias("chain"), F.col("parent").alias("top"))
        found = level.select("node", F.col("top").alias("ancestor"), F.lit(k).alias("level"))
        out = found if out is None else out.union(found)
    return out.groupBy("node", "ancestor").agg(F.min("level").alias("level"))


def capped_relations(relations: DataFrame, review: list[str], order: list, limit: int = OWNERSHIP_RELATIONS) -> DataFrame:
    """relations with kept: the first of each review up to the limit."""
    return relations.withColumn("kept", F.row_number().over(Window.partitionBy(*review).orderBy(*order)) <= limit)


def primary_placements(placements: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One parent for each child: of the head revision first, then the one that sorts first (keys, child, parent, in_head)."""
    ranked = placements.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "child").orderBy(F.col("in_head").desc(), "parent")))
    return ranked.where("place = 1").select(*keys, "child", "parent")


def lifted_endpoints(source_chain: Column, target_chain: Column) -> tuple[Column, Column]:
    """The chains' (root to node) nodes just below their lowest common owner; a node itself where it owns the other."""
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(source_chain), F.size(target_chain))), lambda i: F.slice(source_chain, F.lit(1), i) == F.slice(target_chain, F.lit(1), i)))
    pick = lambda chain: F.element_at(chain, F.least(shared + 1, F.size(chain)))
    return pick(source_chain), pick(target_chain)


def grouped_edges(edges: DataFrame, chains: DataFrame, by: list[str] = ()) -> DataFrame:
    """edges (by, source, target) with lifted_source and lifted_target, by chains (by, node, chain)."""
    joined = edges.join(chains.select(*by, F.col("node").alias("source"), F.col("chain").alias("source_chain")), [*by, "source"])
    joined = joined.join(chains.select(*by, F.col("node").alias("target"), F.col("chain").alias("target_chain")), [*by, "target"])
    low, high = lifted_endpoints(F.col("source_chain"), F.col("target_chain"))
    return joined.withColumn("lifted_source", low).withColumn("lifted_target", high).drop("source_chain", "target_chain")


def relation_groups(edges: DataFrame, chains: DataFrame, keys: list[str], by: list[str] = (), count: str = "n_edges") -> DataFrame:
    """by, lifted_source, lifted_target, keys and counts of edges with ends lifted by chains."""
    return grouped_edges(edges, chains, by).groupBy(*by, "lifted_source", "lifted_target", *keys).agg(F.count("*").alias(count))


def change_backbone(edges: DataFrame, seeds: DataFrame, parents: DataFrame) -> DataFrame:
    """node and role: seeds, nodes one edge from a seed (contact), and owners of all those (owner); the strongest role.

    edges: source, target; seeds: node; parents: child, parent.
    """
    touching = edges.join(seeds.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node"))
    touching = touching.union(edges.join(seeds.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node")))
    inner = seeds.select("node", F.lit(0).alias("rank")).union(touching.select("node", F.lit(1).alias("rank")))
    inner = inner.groupBy("node").agg(F.min("rank").alias("rank"))
    above = ancestors(parents, inner.select("node")).select(F.col("ancestor").alias("node"), F.lit(2).alias("rank"))
    best = inner.union(above).groupBy("node").agg(F.min("rank").alias("rank"))
    return best.select("node", F.element_at(F.array(F.lit("seed"), F.lit("contact"), F.lit("owner")), F.col("rank") + 1).alias("role"))


def file_rollup(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """source_file, target_file, n_relations and kinds of edges (source, target, relation) between nodes of two files (node, file)."""
    joined = edges.join(owners.select(F.col("node").alias("source"), F.col("file").alias("source_file")), "source").join(owners.select(F.col("node").alias("target"), F.col("file").alias("target_file")), "target")
    apart = joined.where("source_file <> target_file")
    return apart.groupBy("source_file", "target_file").agg(F.count("*").alias("n_relations"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("kinds"))


def retained_bridges(edges: DataFrame, changed: DataFrame, depth: int = 4) -> DataFrame:
    """file of retained files that lie on a chain of edges from one changed file to another, through retained files only.

    edges: source, target; changed: file. Declared by reach, not by one search's order: some changed s reaches r, and r
    some other changed t, within so many edges either way.
    """
    inner = edges.join(changed.select(F.col("file").alias("target")), "target", "left_anti")
    # (file, end): a changed file that reaches it, and one that it reaches
    start = inner.join(changed.select(F.col("file").alias("source")), "source", "left_semi").select(F.col("target").alias("file"), F.col("source").alias("end")).distinct()
    reached = level = start
    for _ in range(depth - 1):
        level = level.join(inner.withColumnRenamed("source", "file"), "file").select(F.col("target").alias("file"), "end").distinct()
        reached = reached.union(level)
    out = edges.join(changed.select(F.col("file").alias("source")), "source", "left_anti")
    goal = out.join(changed.select(F.col("file").alias("target")), "target", "left_semi").select(F.col("source").alias("file"), F.col("target").alias("goal")).distinct()
    reaches = level = goal
    for _ in range(depth - 1):
        level = level.join(inner.select(F.col("target").alias("file"), "source"), "file").join(changed.select(F.col("file").alias("source")), "source", "left_anti").select(F.col("source").alias("file"), "goal").distinct()
        reaches = reaches.union(level)
    return reached.distinct().join(reaches.distinct(), "file").where("end <> goal").select("file").distinct()


def membership_class(association: Column) -> Column:
    """asserted, matched, suggested or context."""
    return F.when(association.isin("provided_association", "explicit_reference"), "asserted").when(association == "exact_identifier", "matched").when(association.isin("distinctive_phrase", "claim_bridge"), "suggested").otherwise("context")


# States of diagnostics that leave a focus unassociated, or its evidence unavailable.
UNASSOCIATED = ("no_association", "no_eligible_fact")
UNAVAILABLE = ("provider_unavailable", "not_applicable", "source_absent", "stale_source", "partial_coverage")


def disposition_state(projected: Column, n_deferred: Column, n_other: Column, states: Column) -> Column:
    """A focus's disposition by what it has: members, deferred structural candidates, other candidates, diagnostic states."""
    some = lambda words: F.arrays_overlap(states, F.array(*map(F.lit, words)))
    return (
        F.when(projected, "projected").when(n_deferred > 0, "deferred").when(n_other > 0, "non_structural_only")
        .when(some(UNASSOCIATED), "unassociated").when(some(UNAVAILABLE), "unavailable").otherwise("no_structural_evidence")
    )


def support_delta(operations: Column, file_status: Column, is_file: Column, sides: Column) -> Column:
    """A node's change: its changed rows' only operation, else a file's status, else retained if both revisions have it."""
    own = F.filter(F.array_distinct(operations), lambda o: o.isin("added", "modified", "renamed", "removed"))
    both = F.array_contains(sides, "base") & F.array_contains(sides, "head")
    return F.when(F.size(own) == 1, own[0]).when(is_file & file_status.isNotNull(), file_status).when(both, "retained").otherwise("unresolved")


def executable_head_path(side: Column, runtime: Column, steps: Column, outgoing: bool = False) -> Column:
    """Head, runtime, with steps, all of them calls or instantiations (and outgoing)."""
    fits = F.forall(steps, lambda s: s["relation"].isin("calls", "instantiates") & ((s["direction"] == "outgoing") if outgoing else F.lit(True)))
    return (side == "head") & runtime & (F.size(steps) > 0) & fits


def path_nodes(steps: Column) -> Column:
    """A path's nodes in order: the first source and each step's target."""
    return F.when(F.size(steps) > 0, F.concat(F.array(steps[0]["source"]), F.transform(steps, lambda s: s["target"]))).otherwise(F.array().cast("array<string>"))
