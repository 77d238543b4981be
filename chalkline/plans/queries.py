"""The registered queries: each operator on the driver's tables, by an analogue where they have no such rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.functions import lexical, paths
from chalkline.operators import assessment, association, closure, convergence, delta, evaluation, facts, graph, overlap, rollups, scan
from chalkline.sources import diffs, markdown

#: Orders and events before these instants are the base revision.
HALF_ORDERS, HALF_EVENTS = "1998-04-26", "2024-01-16"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _joined(column: str) -> Column:
    return F.array_join(column, ",")


def semantic_tokens(t: Tables) -> DataFrame:
    return lexical.each(t.documents, lexical.semantic_tokens(F.col("text")), "token", "doc_id")


def identifier_keys(t: Tables) -> DataFrame:
    name = F.translate(F.concat_ws("_", "p_brand", "p_type", "p_name"), "# ", "x_")
    return t.part.select("p_partkey", F.explode(lexical.identifier_keys(name)).alias("key"))


def association_signature(t: Tables) -> DataFrame:
    signed = t.part.select("p_partkey", lexical.association_signature(F.col("p_name"), F.concat_ws("_", "p_type", "p_brand")).alias("s"))
    return signed.select("p_partkey", F.array_join("s.identifiers", ",").alias("identifiers"), F.array_join("s.tokens", ",").alias("tokens"))


def distinctive_terms(t: Tables) -> DataFrame:
    tokens = t.benchmark.select("item_id", lexical.semantic_tokens(F.col("text")).alias("tokens"))
    return lexical.distinctive_terms(tokens, ["item_id"])


def _association(t: Tables) -> DataFrame:
    signed = lambda df, key: df.select(key, lexical.semantic_tokens(F.col("text")).alias("tokens"))
    # dealt by document once; the pairs, many times as many rows, are never shuffled
    dealt = t.documents.select("doc_id", "text").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return association.text_association(signed(t.benchmark, "item_id"), signed(dealt, "doc_id"), "item_id", "doc_id")


def text_association(t: Tables) -> DataFrame:
    return _association(t)


def phrase_cohort(t: Tables) -> DataFrame:
    pairs = _association(t).join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("discriminative", F.col("n_distinctive") >= 8)
    return association.phrase_cohort(pairs, "item_id", "lang", "discriminative").select("item_id", "doc_id", "lang", "n_distinctive")


def _paths(t: Tables) -> DataFrame:
    root = F.element_at(F.array(*map(F.lit, ("src/app", "tests", "docs", ".github/workflows", "lib/vendor"))), (F.col("p_size") % 5 + 1).cast("int"))
    end = F.element_at(F.array(*map(F.lit, (".py", ".md", ".json", "_test.py", "", ".lock"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    folder = F.lower(F.col("p_type"))
    return t.part.select("p_partkey", F.concat(root, F.lit("/"), folder, F.lit("/"), F.translate("p_name", " ", "_"), end).alias("path"))


def path_profile(t: Tables) -> DataFrame:
    return _paths(t).select("p_partkey", paths.path_classification(F.col("path")).alias("classification"), paths.fact_profile(F.col("path")).alias("profile"))


def arch_layer(t: Tables) -> DataFrame:
    return _paths(t).select("p_partkey", paths.architectural_domain(F.col("path")).alias("domain"), paths.architectural_layer(F.col("path")).alias("layer"))


def evidence_ids(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", facts.evidence_id("order", F.col("o_custkey"), F.col("o_orderkey")).alias("id"))


def line_overlap(t: Tables) -> DataFrame:
    lines = t.events.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("line"), "event_type")
    users = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    spans = [users.select("user_id", F.lit(w).alias("w"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / w))).alias("k")) for w in (5, 10, 20)]
    # spans leave gaps, so some lines fall to wider ones and some to none
    spans = reduce(DataFrame.union, spans).select("user_id", F.concat("w", F.lit("/"), "k").alias("span_id"), (F.col("w") * F.col("k") + 1).alias("start_line"), (F.col("w") * (F.col("k") + 1) - 2).alias("end_line"))
    return overlap.overlaps(lines, spans, "user_id").select("user_id", "span_id", "n_lines", _joined("lines").alias("lines"))


def _half_orders(t: Tables) -> DataFrame:
    return t.orders.withColumn("side", F.when(F.col("o_orderdate") < F.lit(HALF_ORDERS).cast("timestamp"), "base").otherwise("head"))


def _delta(t: Tables) -> DataFrame:
    rows = _half_orders(t)
    seen = delta.sides(rows, ["o_custkey"]).where("in_base and in_head").select("o_custkey")
    return delta.counterpart_delta(rows, ["o_custkey", "o_orderstatus", "o_orderpriority"], seen, ["o_custkey"])


def counterpart_delta(t: Tables) -> DataFrame:
    return _delta(t)


def replacement_pairs(t: Tables) -> DataFrame:
    rows = _delta(t).withColumn("id", F.concat_ws(":", "o_custkey", "o_orderstatus", "o_orderpriority"))
    return delta.replacement_pairs(rows, "id", ["o_custkey"], "o_orderstatus")


def relation_delta(t: Tables) -> DataFrame:
    rows = _half_orders(t).join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("o_custkey").cast("string").alias("customer"), F.col("p_brand").alias("brand"), "side").distinct()
    own = delta.sides(rows, ["customer"])
    changed = own.where("in_base <> in_head").select(F.col("customer").alias("node"), F.when(F.col("in_head"), "added").otherwise("removed").alias("operation"))
    whole = _half_orders(t).groupBy(F.col("o_custkey").cast("string").alias("node"), "side").count().where("count >= 5").select("node", "side")
    return delta.relation_delta(rows, "customer", "brand", changed, whole)


def _supply_edges(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()


def bounded_paths(t: Tables) -> DataFrame:
    """Customers to orders to parts and on to other orders: all edges, three seeds."""
    placed = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"))
    held = t.lineitem.select(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey"))
    seeds = t.spark.createDataFrame([("c1",), ("c2",), ("c4",)], "seed string")
    return graph.bounded_paths(placed.union(held).distinct(), seeds).select("seed", "depth", F.array_join("nodes", ">").alias("path"))


def _owners(t: Tables) -> DataFrame:
    named = lambda df, child, parent, a, b: df.select(F.concat(F.lit(a), child).alias("child"), F.concat(F.lit(b), parent).alias("parent"))
    return (
        named(t.nation, "n_nationkey", "n_regionkey", "n", "r")
        .union(named(t.customer, "c_custkey", "c_nationkey", "c", "n"))
        .union(named(t.supplier, "s_suppkey", "s_nationkey", "s", "n"))
    )


def ownership_ancestry(t: Tables) -> DataFrame:
    orders = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("child"), F.concat(F.lit("c"), "o_custkey").alias("parent"))
    return graph.ancestors(_owners(t).union(orders), orders.select(F.col("child").alias("node")))


def lca_groups(t: Tables) -> DataFrame:
    edges = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.col("l_linestatus").alias("relation"))
    nation = t.nation.select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("r"), F.concat(F.lit("n"), "n_nationkey").alias("n"))
    own = lambda df, key, at, mark: df.join(F.broadcast(nation), F.col(at) == F.col("n_nationkey")).select(F.concat(F.lit(mark), key).alias("node"), F.array("r", "n", F.concat(F.lit(mark), key)).alias("chain"))
    chains = own(t.customer, "c_custkey", "c_nationkey", "c").union(own(t.supplier, "s_suppkey", "s_nationkey", "s"))
    return graph.relation_groups(edges, chains, ["relation"])


def change_backbone(t: Tables) -> DataFrame:
    seeds = t.spark.createDataFrame([("s1",), ("s2",), ("s3",)], "node string")
    return graph.change_backbone(_supply_edges(t), seeds, _owners(t))


def file_rollup(t: Tables) -> DataFrame:
    owners = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_brand").alias("file")).union(t.supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("nation"), "s_nationkey")))
    return graph.file_rollup(_supply_edges(t).withColumn("relation", F.lit("calls")), owners)


def retained_bridges(t: Tables) -> DataFrame:
    edges = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    edges = edges.select(F.concat(F.lit("n"), "c_nationkey").alias("source"), F.concat(F.lit("p"), "o_orderkey").alias("target")).distinct()
    back = t.supplier.select(F.concat(F.lit("p"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target")).distinct()
    changed = t.spark.createDataFrame([("n1",), ("n4",), ("n9",)], "file string")
    return graph.retained_bridges(edges.union(back), changed, depth=3)


def merge_facts(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "props", F.dayofmonth("ts").alias("day"), (F.col("value") > 20).alias("changed"), F.when(F.col("value") > 60, "removed").otherwise("added").alias("operation"))
    folded = facts.merge_facts(rows, ["user_id", "event_type"], "event_id", first=["props"], unions=["day"], operation="operation")
    return folded.select("user_id", "event_type", "changed", "operation", F.col("props").alias("first_props"), _joined("day").alias("days"))


def canonical_target(t: Tables) -> DataFrame:
    tier = F.array_position(F.array(*map(F.lit, "ANR")), F.col("l_returnflag"))
    ranked = convergence.canonical_targets(t.lineitem.withColumn("tier", tier), ["l_partkey"], ["tier", "l_orderkey", "l_linenumber"])
    return ranked.where("canonical").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")


def _slots(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.floor(F.col("value") / 25).cast("int").alias("tier"))
    return convergence.competitive_slot(rows, ["user_id"], "tier", ["tier", "event_id"], keep=2, inspect=12)


def slot_budget(t: Tables) -> DataFrame:
    return _slots(t).where("place <= 12").select("user_id", "event_id", "tier", "place", "selected", "ambiguous")


def partition_check(t: Tables) -> DataFrame:
    slots = _slots(t)
    return convergence.partition_check(t.events, [slots.where("selected"), slots.where("not selected")], ["event_id"])


def anchor_budget(t: Tables) -> DataFrame:
    rows = t.customer.select("c_nationkey", "c_custkey", (F.col("c_acctbal") < 0).alias("bridged"))
    return convergence.anchor_budget(rows, ["c_nationkey"], "bridged", ["c_custkey"], 20, 10, 30).where("selected").select("c_nationkey", "c_custkey", "bridged")


def _checks(t: Tables) -> DataFrame:
    value = F.col("value")
    conclusion = F.when(value > 60, "failure").when(value > 40, "neutral").when(value > 10, "success").when(value > 5, "pending")
    return t.events.withColumn("conclusion", conclusion).withColumn("status", F.when(value > 5, "completed").otherwise("queued"))


def verification_convergence(t: Tables) -> DataFrame:
    rows = _checks(t).withColumn("outcome", convergence.check_outcome(F.col("status"), F.col("conclusion")))
    found = convergence.check_convergence(rows, ["user_id"], ["event_type"], "outcome", ["event_id"], 3)
    return found.select("user_id", "event_type", "event_id", "outcome", "conflicting", "identity_place", "selected")


def ci_state(t: Tables) -> DataFrame:
    current = F.col("ts") >= F.lit(HALF_EVENTS).cast("timestamp")
    return rollups.ci_state(_checks(t), ["user_id"], current)


def verification_status(t: Tables) -> DataFrame:
    current = F.col("ts") >= F.lit(HALF_EVENTS).cast("timestamp")
    return assessment.verification_status(_checks(t), ["user_id", "event_type"], current, F.col("user_id") % 2 == 0)


def closure_scan(t: Tables) -> DataFrame:
    word = F.regexp_extract("text", "[A-Za-z]{7,}", 0)
    selectors = t.benchmark.select("item_id", word.alias("value"), F.lit(False).alias("phrase")).where("value <> ''")
    files = scan.read_until(t.documents.select("doc_id", "text", F.octet_length("text").alias("size")), "size", ["doc_id"]).where("within")
    found = scan.line_matches(files, selectors, "doc_id", "item_id")
    return scan.capped_matches(found, "item_id", ["doc_id", "line"]).select("item_id", "doc_id", "line", "place")


def predicate_rollup(t: Tables) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_quantity") > 30, "contradicted").otherwise("unverified")).when(F.col("l_linestatus") == "F", "demonstrated").otherwise("partial")
    return assessment.predicate_rollup(t.lineitem.withColumn("status", status), ["l_orderkey"])


def component_rollup(t: Tables) -> DataFrame:
    status = F.element_at(F.create_map(F.lit("F"), F.lit("demonstrated"), F.lit("P"), F.lit("partial"), F.lit("O"), F.lit("unverified")), F.col("o_orderstatus"))
    rows = t.orders.withColumn("status", F.when(F.col("o_totalprice") > 480000, "contradicted").otherwise(status)).withColumn("component", F.col("o_orderpriority"))
    return assessment.component_rollup(rows, ["o_custkey"], ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))


def ordered_path(t: Tables) -> DataFrame:
    return assessment.ordered_match(t.events, ["user_id"], "ts", "event_type", ("view", "click", "purchase"))


def _rankings(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = t.documents.select("lang", "doc_id", "n_chars")
    gold = t.labels.where("quality = 1").select("doc_id").join(t.documents.select("doc_id", "lang"), "doc_id").where("lang <> 'fr'")
    order = [(-F.col("n_chars")).alias("n_chars"), F.col("doc_id")]
    return evaluation.telling_places(docs, gold, ["lang"], "doc_id", order, 50), gold, docs.select("lang").distinct()


def query_scores(t: Tables) -> DataFrame:
    scores = evaluation.query_scores(*_rankings(t), "lang", "doc_id", "place", 50)
    return scores.select("lang", "n_expected", "n_returned", "n_hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "reciprocal_rank")])


def retrieval_metrics(t: Tables) -> DataFrame:
    metrics = evaluation.retrieval_metrics(evaluation.query_scores(*_rankings(t), "lang", "doc_id", "place", 50))
    return metrics.select("n_positive", "n_negative", *[F.round(c, 9).alias(c) for c in ("precision_at_k", "recall_at_k", "mrr", "no_match_accuracy")])


def missed_gates(t: Tables) -> DataFrame:
    gates = {"precision_at_k": 0.5, "recall_at_k": 0.9, "mrr": 0.2, "no_match_accuracy": 1.0}
    return evaluation.missed_gates(retrieval_metrics(t), gates)


def disposition_metrics(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    found = evaluation.disposition_metrics(rows, "quality", "toxic", ["lang"])
    return found.select("lang", "n_both", "n_false_selected", "n_false_rejected", "n_neither", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "disposition_accuracy")])


def _days(t: Tables, kinds: tuple[str, ...]) -> DataFrame:
    return t.events.where(F.col("event_type").isin(*kinds)).select(F.dayofmonth("ts").alias("day"), "user_id", "event_type")


def set_comparison(t: Tables) -> DataFrame:
    return evaluation.set_comparison(_days(t, ("view",)), _days(t, ("purchase",)), ["day"], "user_id")


def role_comparison(t: Tables) -> DataFrame:
    return evaluation.role_comparison(_days(t, ("view", "click")), _days(t, ("click", "purchase")), ["day"], "user_id", "event_type")


def compared_outcomes(t: Tables) -> DataFrame:
    first = _half_orders(t).groupBy("o_custkey", "side").agg(F.min("o_orderstatus").alias("status"), F.max("o_orderpriority").alias("priority"))
    return evaluation.compared_outcomes(first.where("side = 'base'"), first.where("side = 'head'"), ["o_custkey"], ["status", "priority"])


def partition_faults(t: Tables) -> DataFrame:
    told = t.lineitem.select("l_orderkey", "l_linenumber").where("l_linenumber <= 3").withColumnsRenamed({"l_orderkey": "request", "l_linenumber": "item"})
    own = t.lineitem.select("l_orderkey", "l_linenumber").where("l_quantity < 25").withColumnsRenamed({"l_orderkey": "request", "l_linenumber": "item"})
    return evaluation.partition_faults(own, told, "request", "item")


def lane_union(t: Tables) -> DataFrame:
    return facts.lanes({k: t.events.where(F.col("event_type") == k) for k in ("view", "click", "purchase", "error", "signup")}, ["event_id", "user_id"])


def admission_tiers(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_partkey", F.floor(F.col("l_quantity") / 8).cast("int").alias("tier"))
    return convergence.admission_tiers(rows, ["l_suppkey"], "l_partkey", "tier", 40)


def admission_state(t: Tables) -> DataFrame:
    return convergence.admission_state(admission_tiers(t), ["l_suppkey"], F.col("l_partkey") % 97 == 0)


def char_budget(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("n"))
    return convergence.char_budget(rows, ["conv_id"], ["turn"], "n", 400, 1500).select("conv_id", "turn", "used")


def diagnostic_groups(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"), (F.col("value") > 20).alias("high"), "user_id", "props")
    return rollups.diagnostic_groups(rows, ["event_type", "day", "hour", "high"], "user_id", "props")


def index_state(t: Tables) -> DataFrame:
    requested = t.customer.select("c_nationkey", F.col("c_custkey").alias("path"), F.floor(F.col("c_acctbal") / 1000).cast("string").alias("content_hash"))
    indexed = t.orders.groupBy(F.col("o_custkey").alias("path")).agg(F.floor(F.max("o_totalprice") / 100000).cast("string").alias("content_hash"))
    states = overlap.index_state(requested, indexed).join(requested.select("path", "c_nationkey"), "path")
    return overlap.index_summary(states, ["c_nationkey"])


def diff_relations(t: Tables) -> DataFrame:
    """Patches made of part names: a line kept, one replaced, one added."""
    name = F.col("p_name")
    patch = F.concat(F.lit("@@ -1,2 +1,3 @@\n "), name, F.lit("\n-old "), F.col("p_brand"), F.lit("\n+new "), F.col("p_type"), F.lit("\n+more\n@@ -10 +11 @@\n-x\n+y"))
    lines = diffs.patch_lines(t.part.select("p_partkey", patch.alias("patch")), ["p_partkey"])
    found = diffs.change_relations(lines, ["p_partkey"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["number"].cast("string"), F.lit(":"), x["text"])), "|")
    return found.select("p_partkey", "hunk", "ordinal", "kind", text("added").alias("added"), text("removed").alias("removed"))


def markdown_statements(t: Tables) -> DataFrame:
    """Bodies made of benchmark texts below headings."""
    body = F.concat(F.lit("Intro of "), F.col("item_id").cast("string"), F.lit(".\n\n## Requirements\n- "), F.translate("text", "\n", " "), F.lit("\n- no `Legacy` rows\n## Summary\n"), F.translate("text", "\n", " "), F.lit("\n"))
    read = markdown.statements(t.benchmark.select("item_id", body.alias("body")), ["item_id"])
    return read.select("item_id", "ordinal", "role", "purpose", "text", "line")


def budgeted_paths(t: Tables) -> DataFrame:
    """Supply edges of each nation's suppliers as a review: two seeds each, all budgets."""
    edges = t.lineitem.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = edges.select(F.col("s_nationkey").cast("string").alias("review_id"), F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("calls").alias("relation"), F.col("l_partkey").alias("order")).distinct()
    seeds = t.supplier.withColumn("n", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).where("n <= 2").select(F.col("s_nationkey").cast("string").alias("review_id"), F.concat(F.lit("s"), "s_suppkey").alias("seed"), F.col("n").alias("order"))
    found = graph.budgeted_paths(edges, seeds)
    return found.select("review_id", "kind", "seed", "ordinal", F.array_join("nodes", ">").alias("path"), F.array_join("detail", ",").alias("detail"))


def greedy_closure(t: Tables) -> DataFrame:
    """Orders as paths of a customer along their parts; parts of open lines are selected anchors, an order's last part is a
    runtime context and the suppliers of returned lines are direct test contexts."""
    keys = [F.lit("all").alias("review_id"), F.col("o_custkey").cast("string").alias("focus_id")]
    # lines meet by order first, and whole, so that paths, anchors and contexts read one shuffle of them
    line = F.struct(F.col("l_partkey").cast("string").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"))
    orders = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines")).join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    told = lambda test, name: F.array_compact(F.array_distinct(F.transform(F.filter("lines", test), lambda x: x[name])))
    nodes, open_ = F.array_sort(told(lambda x: F.lit(True), "part")), F.array_sort(told(lambda x: x["status"] == "O", "part"))
    orders = orders.select(*keys, "o_orderkey", nodes.alias("nodes"), open_.alias("open"), told(lambda x: x["flag"] == "R", "supplier").alias("returned"))
    keys, order = closure.KEYS, F.col("o_orderkey").cast("string")
    paths = orders.select(*keys, order.alias("target_id"), F.size("nodes").alias("depth"), F.col("o_orderkey").alias("rank"), "nodes", F.transform("open", lambda p: F.concat(F.lit("A"), p)).alias("bridge_ids"))
    anchors = orders.select(*keys, F.explode("open").alias("node_id")).withColumn("target_id", F.concat(F.lit("A"), "node_id"))
    context = lambda slot, target, rank, ordinal, bridges: F.struct(F.lit(slot).alias("slot"), target.alias("target_id"), rank.cast("long").alias("rank"), ordinal.cast("long").alias("source_ordinal"), bridges.cast("array<string>").alias("bridge_ids"))
    led = context("runtime_context", F.element_at("nodes", -1), F.col("o_orderkey"), F.col("o_orderkey"), F.array(order))
    direct = F.transform("returned", lambda s: context("test_context", F.concat(F.lit("S"), s), s, F.lit(0), F.array()))
    contexts = orders.select(*keys, F.inline(F.concat(F.array(led), direct)))
    return closure.structural_closure(paths, anchors, contexts).drop("review_id")


_OWN = (
    semantic_tokens, identifier_keys, association_signature, distinctive_terms, text_association, phrase_cohort, path_profile, arch_layer, evidence_ids,
    line_overlap, counterpart_delta, replacement_pairs, relation_delta, bounded_paths, ownership_ancestry, lca_groups, change_backbone, file_rollup,
    retained_bridges, merge_facts, canonical_target, slot_budget, partition_check, anchor_budget, verification_convergence, ci_state,
    verification_status, closure_scan, predicate_rollup, component_rollup, ordered_path, query_scores, retrieval_metrics, missed_gates,
    disposition_metrics, set_comparison, role_comparison, compared_outcomes, partition_faults, lane_union, admission_tiers, admission_state,
    char_budget, diagnostic_groups, index_state, diff_relations, markdown_statements, budgeted_paths, greedy_closure,
)


def _bound(query):
    return lambda spark, sf_dir: query(Tables(spark, sf_dir))


QUERIES = {q.__name__: _bound(q) for q in _OWN}
