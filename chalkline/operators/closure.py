"""Structural closure: which paths and contexts a focus keeps, chosen greedily under caps, with what the caps left out.

Joins make the obligations and their options for all focuses at once: pairs of selected symbols that follow one another on a
path, and context symbols that paths lead to. The choice depends on what was chosen before, so a focus's obligations are read
one after another, in order: a task holds the options of one obligation and what was chosen so far, whatever the number of
focuses it reads.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Caps of paths for an anchor and a focus, and of contexts for each slot.
PER_ANCHOR, PATHS, CONTEXTS = 5, 30, 20
CONTEXT_SLOTS = ("runtime_context", "test_context")  # by name, as options are sorted
BATCH = 10_000  # rows told at once
KEYS = ["review_id", "focus_id"]
OPTION = ["phase", "first", "slot", "goal", "other", "path", "depth", "rank", "anchors"]
ROWS = "review_id string, focus_id string, kind string, slot string, id string, other string, place int"


def connections(on: Column) -> Column:
    """Pairs of symbols that follow one another among a path's selected ones, each once."""
    rest = F.greatest(F.size(on) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(on, F.lit(1), rest), F.slice(on, F.lit(2), rest), lambda a, b: F.struct(a.alias("source"), b.alias("target"))))


def canonical(rows: DataFrame, order: list) -> DataFrame:
    """One row for each focus and target, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS, "target_id").orderBy(*order))).where("_n = 1").drop("_n")


def options(paths: DataFrame, anchors: DataFrame, contexts: DataFrame) -> DataFrame:
    """KEYS, OPTION: each obligation with each path that would meet it and the path's sponsors, and contexts by themselves.

    paths: KEYS, target_id, depth, rank (place in the relations' order), nodes, bridge_ids (anchors); anchors: KEYS, target_id
    and node_id of the selected ones; contexts: KEYS, slot, target_id, rank, source_ordinal, bridge_ids (paths; none: direct).
    """
    paths, contexts = canonical(paths, ["rank"]), canonical(contexts, ["rank"])
    goal = lambda phase, first, slot, goal, other: F.struct(F.lit(phase).alias("phase"), first.cast("long").alias("first"), slot.alias("slot"), goal.alias("goal"), other.cast("string").alias("other"))
    none = F.lit(None)

    # paths that an anchor sponsors, and what of their nodes is selected in their focus
    picked = anchors.groupBy(*KEYS).agg(F.collect_set("target_id").alias("sponsors"), F.collect_set("node_id").alias("selected"))
    paths = paths.where(F.size("bridge_ids") > 0).join(picked, KEYS)
    paths = paths.select(*KEYS, F.col("target_id").alias("path"), F.col("depth").cast("int").alias("depth"), "rank", "nodes", F.array_intersect("nodes", "selected").alias("on"), F.array_sort(F.array_intersect("bridge_ids", "sponsors")).alias("anchors")).where(F.size("anchors") > 0)
    pairs = F.transform(connections(F.filter("nodes", lambda n: F.array_contains("on", n))), lambda c: goal(1, F.lit(0), F.lit("structural_path"), c["source"], c["target"]))

    # a path meets the contexts that it leads to once; contexts by themselves take no path
    alone = F.size("bridge_ids") == 0
    contexts = contexts.select(*KEYS, "bridge_ids", alone.alias("alone"), F.when(alone, goal(0, F.col("rank"), F.col("slot"), F.col("target_id"), none)).otherwise(goal(2, F.col("source_ordinal"), F.col("slot"), F.col("target_id"), none)).alias("goal"))
    led = contexts.where(~F.col("alone")).select(*KEYS, F.explode("bridge_ids").alias("path"), F.array("goal").alias("goals"))
    met = paths.select(*KEYS, "path", "depth", "rank", "anchors", F.coalesce(pairs, F.array().cast("array<struct<phase:int,first:bigint,slot:string,goal:string,other:string>>")).alias("goals")).unionByName(led, allowMissingColumns=True)
    met = met.groupBy(*KEYS, "path").agg(F.min("depth").alias("depth"), F.min("rank").alias("rank"), F.max("anchors").alias("anchors"), F.flatten(F.collect_list("goals")).alias("goals"))
    direct = contexts.where("alone").select(*KEYS, F.inline(F.array("goal")))
    met = met.select(*KEYS, F.inline("goals"), "path", "depth", "rank", "anchors").unionByName(direct, allowMissingColumns=True)
    return met.select(*(F.col(k).cast("string").alias(k) for k in KEYS), *OPTION)


def cover(goals: list[tuple], meets: dict, per_anchor: int, limit: int, admit) -> tuple[list[str], list[tuple]]:
    """Paths in the order they are chosen, and goals left unmet; a goal takes a chosen path if one meets it, else the first that fits.

    meets: of each goal its (depth, rank, anchor, path), ascending; admit(goal): None, or what is done once it is met.
    """
    chosen: dict[str, None] = {}
    used: dict[str, int] = {}
    unmet = []
    for goal in goals:
        done = admit(goal)
        if done is None:
            continue
        open_ = meets.get(goal, ())
        met = any(path in chosen for *_, path in open_)
        for _, _, anchor, path in () if met else open_:
            if used.get(anchor, 0) < per_anchor and len(chosen) < limit:
                chosen[path], used[anchor], met = None, used.get(anchor, 0) + 1, True
                break
        if met:
            done()
        elif open_:
            unmet.append(goal)
    return list(chosen), unmet


def chosen_of(rows, per_anchor: int, limit: int, caps: dict[str, int]):
    """kind, slot, id and other of one focus, in order; rows: its OPTION in the order of obligations."""
    meets, counts, kept, omitted = {}, dict.fromkeys(CONTEXT_SLOTS, 0), [], []

    def keep(slot, target):
        counts[slot] += 1
        kept.append((slot, target))

    def goals():
        for goal, own in groupby(rows, itemgetter(0, 1, 2, 3, 4)):
            meets.clear()
            if goal[0]:
                meets[goal] = sorted([(depth, rank, anchor, path) for *_, path, depth, rank, anchors in own for anchor in anchors])
            yield goal

    def admit(goal):
        phase, _, slot, target, _ = goal
        if phase == 1:
            return lambda: None
        if counts[slot] >= caps[slot]:
            omitted.append((slot, target))
        elif phase == 0:
            keep(slot, target)
        else:
            return lambda: keep(slot, target)
        return None

    paths, unmet = cover(goals(), meets, per_anchor, limit, admit)
    yield from (("path", "structural_path", p, None) for p in paths)
    yield from (("context", s, t, None) for s, t in kept)
    yield from (("budget_truncated", "structural_path", target, other) for *_, target, other in unmet)
    yield from (("budget_truncated", s, t, None) for s, t in omitted)
    yield from (("upstream_deferred", slot, target, None) for phase, _, slot, target, _ in unmet if phase == 2)


def _values(column):
    """Values of a column of options; text and lists by numpy, which is some times quicker than value by value."""
    import pyarrow as pa

    if pa.types.is_list(column.type):
        at = column.offsets.to_numpy().tolist()
        inner = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).tolist()
        return [inner[a - at[0] : b - at[0]] for a, b in zip(at, at[1:])]
    if pa.types.is_integer(column.type):
        return column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _close(per_anchor: int, limit: int, caps: dict[str, int]):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(c, pa.int32() if c == "place" else pa.string()) for c in ("review_id", "focus_id", "kind", "slot", "id", "other", "place")])
        told = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        rows = (row for batch in batches for row in zip(*map(_values, batch.columns)))
        out = []
        for keys, own in groupby(rows, itemgetter(0, 1)):
            for place, row in enumerate(chosen_of((r[2:] for r in own), per_anchor, limit, caps)):
                out.append((*keys, *row, place))
                if len(out) == BATCH:
                    yield told(out)
                    out = []
        if out:
            yield told(out)

    return run


def structural_closure(paths: DataFrame, anchors: DataFrame, contexts: DataFrame, per_anchor: int = PER_ANCHOR, limit: int = PATHS, runtime: int = CONTEXTS, test: int = CONTEXTS) -> DataFrame:
    """KEYS, kind, slot, id, other and place: chosen paths and contexts, and what is budget_truncated or upstream_deferred.

    Direct contexts come first, then pairs of changed symbols, then contexts by ordinal, runtime before test. A truncated
    pair has its second symbol as other. place is the order of choice.
    """
    # focus first: a sort compares 8 bytes of its first column quickly, and few reviews differ in theirs
    rows = options(paths, anchors, contexts).repartition(*KEYS).sortWithinPartitions("focus_id", "review_id", "phase", "first", "slot", "goal", "other")
    return rows.mapInArrow(_close(per_anchor, limit, dict(zip(CONTEXT_SLOTS, (runtime, test)))), ROWS)
