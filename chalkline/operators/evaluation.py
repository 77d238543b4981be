"""Scores against golden labels: rankings, sets, roles, dispositions, and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def query_scores(ranked: DataFrame, gold: DataFrame, queries: DataFrame, query: str, item: str, place: str, k: int) -> DataFrame:
    """query, n_expected, n_returned, n_hits, precision, recall, reciprocal_rank for every query.

    ranked: query, item, place (from 1); gold: query, item. Precision divides by what is returned in the first k, not by k;
    the reciprocal rank looks at the whole list; a query without gold scores 1 if nothing is returned, else 0.
    """
    hits = ranked.join(gold.select(query, item).distinct().withColumn("good", F.lit(True)), [query, item], "left")
    first = F.col(place) <= k
    scored = hits.groupBy(query).agg(F.count_if(first).alias("n_returned"), F.count_if(first & F.col("good")).alias("n_hits"), F.min(F.when(F.col("good"), F.col(place))).alias("best"))
    expected = gold.select(query, item).distinct().groupBy(query).agg(F.count("*").alias("n_expected"))
    joined = queries.select(query).join(expected, query, "left").join(scored, query, "left").na.fill(0, ["n_expected", "n_returned", "n_hits"])
    empty = F.when(F.col("n_returned") == 0, 1.0).otherwise(0.0)
    negative = F.col("n_expected") == 0
    return joined.select(
        query,
        "n_expected",
        "n_returned",
        "n_hits",
        F.when(negative, empty).when(F.col("n_returned") == 0, 0.0).otherwise(F.col("n_hits") / F.greatest("n_returned", F.lit(1))).alias("precision"),
        F.when(negative, empty).otherwise(F.col("n_hits") / F.greatest("n_expected", F.lit(1))).alias("recall"),
        F.when(negative, empty).otherwise(F.coalesce(1 / F.nullif(F.col("best"), F.lit(0)), F.lit(0.0))).alias("reciprocal_rank"),
    )


def telling_places(candidates: DataFrame, gold: DataFrame, query: list[str], item: str, order: list, k: int) -> DataFrame:
    """query, item and place of what query_scores() looks at in whole rankings: the first k candidates, and the first gold one.

    order: ascending columns that tell a query's candidates apart. The first k are cut in each task before they meet; the
    first gold candidate's place is a count of those before it, so no task sorts a query's whole ranking.
    """
    keyed = candidates.select(*query, item, F.struct(*order).alias("_rank"))
    top = keyed.withColumn("place", F.row_number().over(Window.partitionBy(*query).orderBy("_rank"))).where(F.col("place") <= k)
    best = keyed.join(gold.select(*query, item).distinct(), [*query, item]).groupBy(*query).agg(F.min_by(item, "_rank").alias("_item"), F.min("_rank").alias("_best"))
    before = keyed.join(best, query).where(F.col("_rank") < F.col("_best")).groupBy(*query).agg(F.count("*").alias("_before"))
    first = best.join(before, query, "left").select(*query, F.col("_item").alias(item), (F.coalesce("_before", F.lit(0)) + 1).alias("place"))
    return top.select(*query, item, F.col("place").cast("long").alias("place")).union(first).distinct()


def retrieval_metrics(scores: DataFrame) -> DataFrame:
    """Means over queries with gold (0 without any), and of the others the share with nothing returned (1 without any)."""
    positive = F.col("n_expected") > 0
    mean = lambda c, empty: F.coalesce(F.avg(c), F.lit(empty))
    return scores.agg(
        F.count_if(positive).alias("n_positive"),
        F.count_if(~positive).alias("n_negative"),
        mean(F.when(positive, F.col("precision")), 0.0).alias("precision_at_k"),
        mean(F.when(positive, F.col("recall")), 0.0).alias("recall_at_k"),
        mean(F.when(positive, F.col("reciprocal_rank")), 0.0).alias("mrr"),
        mean(F.when(~positive, F.col("precision")), 1.0).alias("no_match_accuracy"),
    )


def absence_rates(scores: DataFrame) -> DataFrame:
    """no_candidate_rate of queries with gold and false_positive_rate of those without (0 without any)."""
    positive, some = F.col("n_expected") > 0, F.col("n_returned") > 0
    rate = lambda of, is_: F.coalesce(F.avg(F.when(of, is_.cast("int"))), F.lit(0.0))
    return scores.agg(rate(positive, ~some).alias("no_candidate_rate"), rate(~positive, some).alias("false_positive_rate"))


def matched_share(expected: DataFrame, observed: DataFrame, keys: list[str], values: list[str], name: str) -> DataFrame:
    """name: the share of expected rows (keys, values) whose observed row has equal values, nulls too; 1 if nothing is expected."""
    seen = observed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*values).alias("_seen")).dropDuplicates([f"_{k}" for k in keys])
    met = F.lit(True)
    for k in keys:
        met &= F.col(k) == F.col(f"_{k}")
    joined = expected.join(seen, met, "left")
    return joined.agg(F.coalesce(F.avg((F.col("_seen").isNotNull() & F.struct(*values).eqNullSafe(F.col("_seen"))).cast("int")), F.lit(1.0)).alias(name))


def missed_gates(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """metric, value and threshold of metrics (one row) below their thresholds; a threshold max_NAME is a bound of NAME from above."""
    named = [(n, n.removeprefix("max_"), float(t)) for n, t in sorted(thresholds.items())]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(t).alias("threshold"), F.lit(n != c).alias("above")) for n, c, t in named])
    return metrics.select(F.inline(pairs)).where("if(above, value > threshold, value < threshold)").drop("above")


def set_comparison(observed: DataFrame, expected: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, n_shared, n_false_in and n_false_out of observed against expected items."""
    left = observed.select(*keys, item).distinct().withColumn("seen", F.lit(True))
    right = expected.select(*keys, item).distinct().withColumn("wanted", F.lit(True))
    joined = left.join(right, [*keys, item], "full_outer")
    seen, wanted = F.col("seen").isNotNull(), F.col("wanted").isNotNull()
    return joined.groupBy(*keys).agg(F.count_if(seen & wanted).alias("n_shared"), F.count_if(seen & ~wanted).alias("n_false_in"), F.count_if(wanted & ~seen).alias("n_false_out"))


def role_comparison(observed: DataFrame, expected: DataFrame, keys: list[str], item: str, role: str) -> DataFrame:
    """set_comparison() with n_role_disagreements among shared items; an item's role is the one that sorts first."""
    one = lambda df, name: df.groupBy(*keys, item).agg(F.min(role).alias(name))
    joined = one(observed, "seen").join(one(expected, "wanted"), [*keys, item], "full_outer")
    seen, wanted = F.col("seen").isNotNull(), F.col("wanted").isNotNull()
    return joined.groupBy(*keys).agg(
        F.count_if(seen & wanted).alias("n_shared"),
        F.count_if(seen & ~wanted).alias("n_false_in"),
        F.count_if(wanted & ~seen).alias("n_false_out"),
        F.count_if(seen & wanted & (F.col("seen") != F.col("wanted"))).alias("n_role_disagreements"),
    )


def disposition_metrics(rows: DataFrame, expected: str, observed: str, keys: list[str] = ()) -> DataFrame:
    """Counts and ratios of observed against expected selections (0 or 1); a ratio without a denominator is 1."""
    e, o = F.col(expected) == 1, F.col(observed) == 1
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(1.0))
    counted = rows.groupBy(*keys).agg(F.count_if(e & o).alias("n_both"), F.count_if(~e & o).alias("n_false_selected"), F.count_if(e & ~o).alias("n_false_rejected"), F.count_if(~e & ~o).alias("n_neither"))
    both, fs, fr, no = (F.col(c) for c in ("n_both", "n_false_selected", "n_false_rejected", "n_neither"))
    return counted.select(
        *keys,
        "n_both",
        "n_false_selected",
        "n_false_rejected",
        "n_neither",
        ratio(both, both + fs).alias("precision"),
        ratio(both, both + fr).alias("recall"),
        ratio(both + no, both + no + fs + fr).alias("disposition_accuracy"),
    )


def compared_outcomes(expected: DataFrame, observed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, found and one flag for each value: whether the observed row has the expected value."""
    right = observed.select(*keys, *[F.col(v).alias(f"seen_{v}") for v in values], F.lit(True).alias("there"))
    joined = expected.select(*keys, *values).join(right, keys, "left")
    return joined.select(*keys, F.coalesce("there", F.lit(False)).alias("found"), *[F.coalesce(F.col(v).eqNullSafe(F.col(f"seen_{v}")) & F.col("there"), F.lit(False)).alias(f"same_{v}") for v in values])


def partition_faults(candidates: DataFrame, labels: DataFrame, request: str, item: str) -> DataFrame:
    """request, item and fault of labels that don't partition a request's candidates: missing, unknown or repeated."""
    told = labels.groupBy(request, item).agg(F.count("*").alias("times"))
    own = candidates.select(request, item).distinct().withColumn("own", F.lit(True))
    joined = own.join(told, [request, item], "full_outer")
    fault = F.when(F.col("times").isNull(), "missing").when(F.col("own").isNull(), "unknown").when(F.col("times") > 1, "repeated")
    return joined.select(request, item, fault.alias("fault")).where("fault is not null")


def ranked_candidates(candidates: DataFrame, query: list[str], order: list) -> DataFrame:
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*query).orderBy(*order)))


def query_mismatches(observed: DataFrame, expected: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, missing and unexpected (sorted items) of queries whose observed items aren't the expected ones."""
    left = observed.select(*keys, item).distinct().withColumn("seen", F.lit(True))
    right = expected.select(*keys, item).distinct().withColumn("wanted", F.lit(True))
    joined = left.join(right, [*keys, item], "full_outer").where("seen is null or wanted is null")
    only = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag).isNull(), F.col(item))))
    return joined.groupBy(*keys).agg(only("seen").alias("missing"), only("wanted").alias("unexpected"))
