"""Budgeted traversal, ownership chains and structural closure against plain recomputations and hand-written rows."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from chalkline.operators import closure, graph


def walked(edges, seeds, policy):
    """The rule as it is told, seed by seed and turn by turn: (paths, limits of each seed)."""
    depth, seed_nodes, seed_paths, review_nodes, review_paths = policy
    around = {}
    for source, target, relation, order in sorted(edges, key=lambda e: (e[3], e[0], e[1], e[2])):
        around.setdefault(source, []).append((target, relation))
        around.setdefault(target, []).append((source, relation))
    met, found = set(seeds), []
    held = {s: {"nodes": {s}, "n": 0, "limits": set(), "done": False, "levels": [[((s,), ())]]} for s in seeds}
    for level in range(1, depth + 1):
        turns = {}
        for s in seeds:
            held[s]["levels"].append([])
            turns[s] = deque((nodes, rel, n, r) for nodes, rel in held[s]["levels"][level - 1] for n, r in around.get(nodes[-1], ()))
        moved = True
        while moved:
            moved = False
            for s in seeds:
                h = held[s]
                if h["done"]:
                    continue
                if len(found) >= review_paths:
                    for o in held.values():
                        if not o["done"]:
                            o["limits"].add("review_path_budget")
                            o["done"] = True
                    return found, {s: h["limits"] for s, h in held.items()}
                while turns[s]:
                    nodes, rel, n, r = turns[s].popleft()
                    if n in nodes:
                        continue
                    if h["n"] >= seed_paths:
                        h["limits"].add("seed_path_budget")
                        h["done"] = True
                        break
                    if n not in h["nodes"] and len(h["nodes"]) >= seed_nodes:
                        h["limits"].add("seed_node_budget")
                        continue
                    if n not in met and len(met) >= review_nodes:
                        h["limits"].add("review_node_budget")
                        continue
                    h["nodes"].add(n)
                    met.add(n)
                    h["n"] += 1
                    path = (nodes + (n,), rel + (r,))
                    h["levels"][level].append(path)
                    found.append((s, *path))
                    moved = True
                    break
    return found, {s: h["limits"] for s, h in held.items()}


def test_traversal_equals_the_rule(spark):
    rng, edges, seeds, policies = random.Random(9), [], [], {}
    plans = {}
    policy_sets = [(3, 80, 120, 7, 120), (3, 4, 5, 80, 12), (3, 5, 6, 9, 14), (2, 3, 4, 6, 11)]
    for p in policy_sets:
        policies[p] = []
        for g in range(12):
            key, n = f"{policy_sets.index(p)}-{g}", rng.randint(3, 12)
            own = sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["calls", "imports"]), rng.randint(0, 2)) for _ in range(rng.randint(2, 22))})
            names = [f"n{i}" for i in rng.sample(range(n), rng.randint(1, min(4, n)))]
            edges += [(key, *e) for e in own]
            seeds += [(key, s, i) for i, s in enumerate(names)]
            plans[key] = (own, names, p)
            policies[p].append(key)
    edge_table = spark.createDataFrame(edges, "review_id string, source string, target string, relation string, order long")
    seed_table = spark.createDataFrame(seeds, "review_id string, seed string, order long")
    for p, keys in policies.items():
        got = graph.budgeted_paths(edge_table.where(F.col("review_id").isin(keys)), seed_table.where(F.col("review_id").isin(keys)), policy=p).collect()
        for key in keys:
            found, limits = walked(*plans[key])
            mine = sorted((r for r in got if r.review_id == key and r.kind == "path"), key=lambda r: r.ordinal)
            assert [(r.seed, tuple(r.nodes), tuple(r.relations)) for r in mine] == found, (key, p)
            assert [r.ordinal for r in mine] == list(range(len(found)))
            told = {r.seed: tuple(r.detail) for r in got if r.review_id == key and r.kind == "state"}
            assert told == {s: ("truncated", *[x for x in graph.LIMITS if x in had]) if had else ("complete",) for s, had in limits.items()}, (key, p)


def test_a_long_chain_of_owners_and_a_cycle(spark):
    rows = [("r", f"c{i}", f"c{i - 1}") for i in range(1, 1000)] + [("r", "x", "y"), ("r", "y", "z"), ("r", "z", "y"), ("q", "self", "self"), ("q", "leaf", "c0")]
    chains, cycles = graph.ownership_chains(spark.createDataFrame(rows, "review_id string, child string, parent string"))
    found = {(r.review_id, r.node): r.chain for r in chains.collect()}
    assert found["r", "c999"] == [f"c{i}" for i in range(1000)] and found["r", "c0"] == ["c0"] and found["q", "leaf"] == ["c0", "leaf"]
    assert sorted(map(tuple, cycles.collect())) == [("q", "self"), ("r", "x"), ("r", "y"), ("r", "z")]
    assert graph.ownership_chains(spark.createDataFrame([], "review_id string, child string, parent string"))[0].collect() == []


PATHS = "review_id string, focus_id string, target_id string, depth int, rank long, nodes array<string>, bridge_ids array<string>"
ANCHORS = "review_id string, focus_id string, target_id string, node_id string"
AROUND = "review_id string, focus_id string, slot string, target_id string, rank long, source_ordinal long, bridge_ids array<string>"


def closed(spark, paths, anchors, contexts, **caps):
    tables = [spark.createDataFrame([("r", *x) for x in rows], schema) for rows, schema in ((paths, PATHS), (anchors, ANCHORS), (contexts, AROUND))]
    return [(r.focus_id, r.kind, r.slot, r.id, r.other) for r in closure.structural_closure(*tables, **caps).orderBy("focus_id", "place").collect()]


def test_closure_by_hand(spark):
    """Symbols a and c follow one another on p1 though b lies between; the terminal t takes the path already chosen."""
    paths = [("R1", "p1", 2, 1, ["a", "b", "c"], ["A", "C"]), ("R1", "p2", 1, 2, ["a", "t"], ["A"]), ("R1", "p1", 3, 9, ["c", "a"], ["A"])]
    anchors = [("R1", "A", "a"), ("R1", "C", "c")]
    contexts = [("R1", "runtime_context", "t", 5, 0, ["p2", "p1"]), ("R1", "test_context", "d", 6, 1, []), ("R1", "runtime_context", "u", 7, 1, ["p9"])]
    assert closed(spark, paths, anchors, contexts) == [("R1", "path", "structural_path", "p1", None), ("R1", "context", "test_context", "d", None), ("R1", "context", "runtime_context", "t", None)]


def test_closure_caps_by_hand(spark):
    paths = [("R1", f"p{i}", 1, i, ["a", f"t{i}"], ["A"]) for i in range(4)]
    contexts = [("R1", "runtime_context", f"t{i}", 10 + i, i, [f"p{i}"]) for i in range(4)] + [("R1", "test_context", "d0", 20, 0, []), ("R1", "test_context", "d1", 21, 0, [])]
    got = closed(spark, paths, [("R1", "A", "a")], contexts, per_anchor=2, runtime=3, test=1)
    assert got == [
        ("R1", "path", "structural_path", "p0", None), ("R1", "path", "structural_path", "p1", None),
        ("R1", "context", "test_context", "d0", None), ("R1", "context", "runtime_context", "t0", None), ("R1", "context", "runtime_context", "t1", None),
        ("R1", "budget_truncated", "structural_path", "t2", None), ("R1", "budget_truncated", "structural_path", "t3", None), ("R1", "budget_truncated", "test_context", "d1", None),
        ("R1", "upstream_deferred", "runtime_context", "t2", None), ("R1", "upstream_deferred", "runtime_context", "t3", None),
    ]


def plain_closure(paths, anchors, contexts, per_anchor, limit, runtime, test):
    """One focus, goal by goal over all paths."""
    best = {}
    for p in sorted(paths, key=lambda p: p[3]):
        best.setdefault(p[1], p)
    first = {}
    for c in sorted(contexts, key=lambda c: c[3]):
        first.setdefault(c[2], c)
    paths, contexts = list(best.values()), list(first.values())
    names, picked = {a[1] for a in anchors}, {a[2] for a in anchors}
    chosen, used, counts, caps = [], {}, {"runtime_context": 0, "test_context": 0}, {"runtime_context": runtime, "test_context": test}
    kept, omitted, truncated, deferred = [], [], [], []

    def meet(fits):
        options = sorted((p[1] not in chosen, p[2], p[3], a, p[1]) for p in paths if fits(p) for a in p[5] if a in names)
        for new, *_, a, p in options:
            if not new:
                return True, True
            if used.get(a, 0) < per_anchor and len(chosen) < limit:
                chosen.append(p)
                used[a] = used.get(a, 0) + 1
                return True, True
        return False, bool(options)

    for c in sorted((c for c in contexts if not c[5]), key=lambda c: (c[3], c[1], c[2])):
        if counts[c[1]] < caps[c[1]]:
            counts[c[1]] += 1
            kept.append((c[1], c[2]))
        else:
            omitted.append((c[1], c[2]))
    pairs = lambda p: {(a, b) for a, b in zip(on, on[1:])} if (on := [n for n in p[4] if n in picked]) else set()
    for pair in sorted({x for p in paths if set(p[5]) & names for x in pairs(p)}):
        if not meet(lambda p: pair in pairs(p))[0]:
            truncated.append(pair)
    for c in sorted((c for c in contexts if c[5]), key=lambda c: (c[4], c[1] != "runtime_context", c[2])):
        if counts[c[1]] >= caps[c[1]]:
            omitted.append((c[1], c[2]))
            continue
        met, some = meet(lambda p: p[1] in c[5])
        if met:
            counts[c[1]] += 1
            kept.append((c[1], c[2]))
        elif some:
            truncated.append((c[2], None))
            deferred.append((c[1], c[2]))
    return chosen, kept, truncated, omitted, deferred


@pytest.mark.parametrize("caps", [(5, 30, 20, 20), (1, 2, 1, 1), (2, 3, 2, 0)])
def test_closure_equals_plain(spark, caps):
    rng, paths, anchors, contexts = random.Random(sum(caps)), [], [], []
    foci = [f"R{i}" for i in range(25)]
    for f in foci:
        names = rng.sample("abcdef", rng.randint(0, 4))
        anchors += [(f, n.upper(), n) for n in names]
        for i in range(rng.randint(0, 8)):
            paths.append((f, f"p{rng.randrange(7)}", rng.randint(1, 3), i, rng.sample("abcdefxyz", rng.randint(2, 5)), rng.sample("ABCDEF", rng.randint(1, 3))))
        for i in range(rng.randint(0, 8)):
            contexts.append((f, rng.choice(closure.CONTEXT_SLOTS), rng.choice("stuvwxyz"), 100 + i, rng.randint(0, 3), rng.sample(["p0", "p1", "p2", "p3", "p9"], rng.randint(0, 3))))
    got = closed(spark, paths, anchors, contexts, **dict(zip(("per_anchor", "limit", "runtime", "test"), caps)))
    for f in foci:
        own = [x[1:] for x in got if x[0] == f]
        pick = lambda kind, own=own: [x for x in own if x[0] == kind]
        chosen, kept, truncated, omitted, deferred = plain_closure(*([x for x in rows if x[0] == f] for rows in (paths, anchors, contexts)), *caps)
        assert [x[2] for x in pick("path")] == chosen and [x[1:3] for x in pick("context")] == kept
        assert [(x[2], x[3]) for x in pick("budget_truncated") if x[1] == "structural_path"] == truncated
        assert [x[1:3] for x in pick("budget_truncated") if x[1] != "structural_path"] == omitted and [x[1:3] for x in pick("upstream_deferred")] == deferred


def test_closure_reads_many_focuses_in_one_pass(spark):
    """A task reads its focuses one after another (a call of Python for each took the query's time); ids repeat across reviews."""
    tables = [
        spark.createDataFrame([(r, f"R{i}", "p", 1, 1, ["a", "b"], ["A"]) for r in "qr" for i in range(300)], PATHS),
        spark.createDataFrame([(r, f"R{i}", "A", n) for r in "qr" for i in range(300) for n in ("a", "b")], ANCHORS),
        spark.createDataFrame([(r, f"R{i}", "runtime_context", f"{r}{i}", 1, 1, ["p"]) for r in "qr" for i in range(300)], AROUND),
    ]
    got = closure.structural_closure(*tables)
    rows = {tuple(r) for r in got.collect()}
    assert rows == {(r, f"R{i}", *x) for r in "qr" for i in range(300) for x in (("path", "structural_path", "p", None, 0), ("context", "runtime_context", f"{r}{i}", None, 1))}
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()


def test_closure_holds_one_obligation_at_a_time():
    """A focus's options are read as they are needed, not gathered first."""
    live = set()

    class Names(list):
        def __del__(self):
            live.discard(id(self))

    def rows():
        for i in range(1000):
            names = Names(["A"])
            live.add(id(names))
            assert len(live) < 5
            yield 1, 0, "structural_path", f"{i:04}", "z", f"p{i}", 1, i, names
            del names

    told = list(closure.chosen_of(rows(), 5, 30, {"runtime_context": 1, "test_context": 1}))
    assert [x[2] for x in told] == [f"p{i}" for i in range(5)] + [f"{i:04}" for i in range(5, 1000)]


def test_greedy_closure_reads_lines_once(spark, sf_dir):
    from chalkline.plans.queries import QUERIES

    got = QUERIES["greedy_closure"](spark, sf_dir)
    assert got.count() and got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and "FlatMapGroups" not in plan
