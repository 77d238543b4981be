"""Stored runs of an outside selector: frozen requests, what a run made of them, and everything derived computed again.

A run is a row of `file`s; its claims are rows. A request has at most 100 candidates, so the rules of one claim are
expressions over its own arrays, and sums of a run are one grouped aggregate. No rule collects; what is wrong is a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators import shadow
from chalkline.sources.artifacts import COMPARISON, NOTES, SELECTION

# Fixed values of the format: bounds, roles and states.
SELECTIONS, DISPOSED, SURFACES, TEXT = 30, 100, 20, 2000
ROLES = ("supporting", "contradicting", "context")
MEANINGS = ("authority", "producer", "consumer", "path", "test", "removal", "boundary", "documentation", "unknown")
EXECUTED = ("accepted", "invalid_output", "provider_error")
READY = ("ready", "ready_truncated")
VERSION = "2"

IDS = "array<string>"


def _list(value: Column, kind: str = IDS) -> Column:
    return F.coalesce(value, F.array().cast(kind))


def _text(value: Column) -> Column:
    return F.coalesce((F.trim(value) != "") & (F.length(value) <= TEXT), F.lit(False))


def _repeats(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) < F.size(ids)


def ordered(request: Column, ids: Column) -> Column:
    """ids without repeats, in the order of the request's candidates; ids it lacks are left out."""
    return F.filter(_list(request["candidates"]["evidence_id"]), lambda c: F.array_contains(_list(ids), c))


def compared(request: Column, deterministic: Column, selection: Column) -> Column:
    """The comparison of one selection with the deterministic evidence of its request."""
    own, seen = ordered(request, deterministic), _list(selection["selections"]["evidence_id"])
    parts = {"deterministic_ids": own, "shadow_ids": seen, "shared_ids": F.array_intersect(own, seen), "deterministic_only_ids": F.array_except(own, seen), "shadow_only_ids": F.array_except(seen, own)}
    return F.struct(*[c.alias(n) for n, c in parts.items()]).cast(COMPARISON)


def selection_faults(selection: Column, request: Column) -> Column:
    """Sorted codes of what keeps a selection from being a whole and valid answer to its request."""
    known = _list(request["candidates"]["evidence_id"])
    picks, rejected, open_ = selection["selections"], selection["rejected_evidence_ids"], selection["insufficient_evidence_ids"]
    picked = _list(picks["evidence_id"])
    surfaces = _list(selection["unresolved_surfaces"])
    among = lambda x, values: F.coalesce(x.isin(*values), F.lit(False))
    each = lambda rule: F.coalesce(F.exists(picks, rule), F.lit(False))
    strange = lambda ids: F.exists(_list(ids), lambda x: ~F.coalesce(F.array_contains(known, x), F.lit(False)))
    lists = [_list(rejected), _list(open_)]
    told = F.concat(*[F.array_distinct(x) for x in (picked, *lists)])
    rules = {
        "schema_mismatch": ~F.coalesce(selection["schema_version"] == VERSION, F.lit(False)),
        "request_mismatch": ~F.coalesce(selection["request_id"] == request["request_id"], F.lit(False)),
        "subject_mismatch": ~F.coalesce(selection["subject_id"] == request["subject_id"], F.lit(False)),
        "invalid_selections": picks.isNull(),
        "invalid_rejected_evidence_ids": rejected.isNull(),
        "invalid_insufficient_evidence_ids": open_.isNull(),
        "selection_budget_exceeded": F.size(picked) > SELECTIONS,
        "candidate_disposition_budget_exceeded": (F.size(lists[0]) > DISPOSED) | (F.size(lists[1]) > DISPOSED),
        "unresolved_surface_budget_exceeded": F.size(surfaces) > SURFACES,
        "invalid_selection": each(lambda p: p.isNull()),
        "unknown_evidence_id": strange(picked) | strange(rejected) | strange(open_),
        "duplicate_evidence_id": _repeats(picked) | _repeats(lists[0]) | _repeats(lists[1]),
        "invalid_evidence_role": each(lambda p: ~among(p["role"], ROLES)),
        "invalid_semantic_role": each(lambda p: ~among(p["semantic_role"], MEANINGS)),
        "invalid_rationale": each(lambda p: ~_text(p["rationale"])),
        "invalid_unresolved_surface": F.exists(surfaces, lambda s: ~_text(s)),
        "overlapping_candidate_disposition": _repeats(told),
        "incomplete_candidate_partition": F.size(F.array_except(known, told)) > 0,
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()])))


def differences(stored: DataFrame, derived: DataFrame, keys: list[str], times: bool = True) -> DataFrame:
    """keys, field, stored and derived (text) of what differs between two tables of equal columns, null-safe and both ways.

    Field is * where a key is missing on one side (that side is null) or, if times, held more often on one side (counts are
    told). Both sides meet in one grouped shuffle, combined before it; null keys meet too.
    """
    fields = [c for c in stored.columns if c not in keys]
    spelled = lambda df, side: df.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias(side))
    both = spelled(stored, "s").unionByName(spelled(derived, "d"), allowMissingColumns=True)
    met = both.groupBy(*keys).agg(F.count("s").alias("n_s"), F.count("d").alias("n_d"), F.min("s").alias("s"), F.min("d").alias("d"))
    row = lambda field, a, b: F.struct(F.lit(field).alias("field"), a.alias("stored"), b.alias("derived"))
    count = lambda n: F.when(F.col(n) > 0, F.col(n).cast("string"))
    each = F.array_compact(F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")), row(c, F.col(f"s.{c}"), F.col(f"d.{c}"))) for c in fields]))
    unlike = (F.col("n_s") == 0) | (F.col("n_d") == 0) | ((F.col("n_s") != F.col("n_d")) if times else F.lit(False))
    return met.select(*keys, F.inline(F.when(unlike, F.array(row("*", count("n_s"), count("n_d")))).otherwise(each)))


def observations(executions: DataFrame) -> DataFrame:
    """file, ordinal and the fields of each claim of stored runs."""
    return executions.select("file", F.posexplode("observations").alias("ordinal", "o")).select("file", "ordinal", "o.*")


def admissions(packets: DataFrame) -> DataFrame:
    """file, ordinal and the fields of each claim of frozen packets."""
    return packets.select("file", F.posexplode("admissions").alias("ordinal", "a")).select("file", "ordinal", "a.*")


def run_totals(claims: DataFrame, files: DataFrame) -> DataFrame:
    """file, state, admitted_count, completed_count, failed_count and deferred_count of runs; files without claims are empty."""
    is_ = lambda c, *values: F.count_if(F.col(c).isin(*values))
    folded = claims.groupBy("file").agg(
        F.count("request").alias("admitted_count"),
        is_("execution_state", "accepted").alias("completed_count"),
        is_("execution_state", "invalid_output", "provider_error").alias("failed_count"),
        is_("execution_state", "deferred").alias("deferred_count"),
        is_("execution_state", "blocked").alias("n_blocked"),
        is_("admission_state", "ready_truncated").alias("n_cut"),
    )
    counts = ("admitted_count", "completed_count", "failed_count", "deferred_count")
    joined = files.select("file").distinct().join(folded, "file", "left").na.fill(0)
    nothing = (F.col("admitted_count") == 0) & (F.col("n_blocked") == 0)
    failed = (F.col("admitted_count") > 0) & (F.col("failed_count") == F.col("admitted_count"))
    some = F.col("failed_count") + F.col("n_blocked") + F.col("n_cut") + F.col("deferred_count") > 0
    state = F.when(nothing, "empty").when(failed, "failed").when(some, "partial").otherwise("completed")
    return joined.select("file", state.alias("state"), *counts)


def _own_evidence(state: Column) -> dict[str, Column]:
    """Rules of an admitted claim's evidence, by the field that breaks them."""
    request, own = F.col("request"), _list(F.col("deterministic_evidence_ids"))
    asked, n = request.isNotNull(), F.coalesce("eligible_count", F.lit(-1))
    ids = _list(request["candidates"]["evidence_id"])
    return {
        "request.subject_id": asked & ~request["subject_id"].eqNullSafe(F.col("claim_id")),
        "request.candidates": asked & (_repeats(ids) | (F.size(ids) > DISPOSED)),
        "request.schema_version": asked & ~request["schema_version"].eqNullSafe(F.lit(VERSION)),
        "deterministic_evidence_ids": F.when(asked, own != ordered(request, own)).otherwise((F.size(own) > 0) & ((state != "blocked") | _repeats(own) | F.exists(own, lambda x: F.coalesce(x, F.lit("")) == ""))),
        "eligible_count": (n < 0) | F.when(asked, n < F.size(ids)).otherwise(n < F.size(own)),
    }


def _claims(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """file, claim_id, field, stored and derived of claims that break rules; repeated claims too."""
    none = F.lit(None).cast("string")
    row = lambda field: F.struct(F.lit(field).alias("field"), none.alias("stored"), none.alias("derived"))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), row(field)) for field, rule in rules.items()]))
    again = df.groupBy("file", "claim_id").agg(F.count("*").alias("n")).where("n > 1 or claim_id is null or claim_id = ''")
    return df.select("file", "claim_id", F.inline(broken)).union(again.select("file", "claim_id", F.lit("claim_id"), F.col("n").cast("string"), F.lit("1")))


def admission_faults(packets: DataFrame) -> DataFrame:
    """file, claim_id, field, stored and derived of what can't be in frozen packets."""
    state = F.coalesce("state", F.lit(""))
    rules = {"state": ~state.isin(*READY, "empty", "blocked"), "request": F.col("request").isNotNull() != state.isin(*READY)}
    return _claims(admissions(packets), rules | _own_evidence(state))


def run_faults(executions: DataFrame) -> DataFrame:
    """file, claim_id (null for a run's sums), field, stored and derived of what doesn't derive from what stored runs recorded."""
    claims = observations(executions)
    did, state = F.coalesce("execution_state", F.lit("")), F.coalesce("admission_state", F.lit(""))
    request, run = F.col("request"), F.col("run")
    ran, chosen = run.isNotNull(), F.col("run.selection").isNotNull()
    accepted = F.coalesce(run["state"] == "accepted", F.lit(False))
    rules = {
        "execution_state": F.when(state.isin(*READY), ~did.isin(*EXECUTED, "deferred")).otherwise(did != state),
        "admission_state": ~state.isin(*READY, "empty", "blocked"),
        "run": ran != did.isin(*EXECUTED),
        "request": request.isNotNull() != did.isin(*EXECUTED, "deferred"),
        "run.state": ran & ~run["state"].eqNullSafe(F.col("execution_state")),
        "run.subject_id": ran & ~run["subject_id"].eqNullSafe(F.col("claim_id")),
        "run.request_id": ran & ~run["request_id"].eqNullSafe(request["request_id"]),
        "run.candidate_count": ran & ~run["candidate_count"].eqNullSafe(F.size(_list(request["candidates"]["evidence_id"]))),
        "run.duration_ms": ran & ~F.coalesce(run["duration_ms"] >= 0, F.lit(False)),
        "run.selection": ran & ((chosen != accepted) | (chosen & (F.size(selection_faults(run["selection"], request)) > 0))),
        "run.comparison": ran & (run["comparison"].isNotNull() != chosen),
    }
    own = _claims(claims, rules | _own_evidence(state))
    # the comparison is computed again and told field by field
    parts = [f.split(":")[0] for f in COMPARISON[len("struct<") : -1].split(",")]
    told = claims.where("run.selection is not null and run.comparison is not null").withColumn("again", compared(request, F.col("deterministic_evidence_ids"), F.col("run.selection")))
    row = lambda f: F.struct(F.lit(f"run.comparison.{f}").alias("field"), F.to_json(F.col(f"run.comparison.{f}")).alias("stored"), F.to_json(F.col(f"again.{f}")).alias("derived"))
    unlike = told.select("file", "claim_id", F.inline(F.array_compact(F.array(*[F.when(~F.col(f"run.comparison.{f}").eqNullSafe(F.col(f"again.{f}")), row(f)) for f in parts]))))
    # sums of a run; one that was never tried has no claims and nothing to sum
    sums = ("state", "admitted_count", "completed_count", "failed_count", "deferred_count")
    tried = executions.where("summary.state is distinct from 'unavailable'")
    stored = tried.select("file", *[F.col(f"summary.{c}") for c in sums])
    off = differences(stored, run_totals(claims, tried), ["file"], times=False).select("file", F.lit(None).cast("string").alias("claim_id"), F.concat(F.lit("summary."), "field").alias("field"), "stored", "derived")
    idle = executions.where("summary.state = 'unavailable' and size(observations) > 0").select("file", F.lit(None).cast("string"), F.lit("observations"), F.size("observations").cast("string"), F.lit("0"))
    return reduce(DataFrame.union, [own, unlike, off, idle])


def packet_differences(packets: DataFrame, executions: DataFrame) -> DataFrame:
    """ordinal, field, stored and derived of what a run (one file) changed of the packet (one file) frozen before it."""
    spelled = lambda df, state: df.select("ordinal", "claim_id", F.col(state).alias("state"), "eligible_count", F.to_json(_list(F.col("deterministic_evidence_ids"))).alias("deterministic_evidence_ids"), F.to_json("request").alias("request"))
    return differences(spelled(observations(executions), "admission_state"), spelled(admissions(packets), "state"), ["ordinal"])


def label_faults(labels: DataFrame, packets: DataFrame) -> DataFrame:
    """claim_id and fault of labels that don't answer the packet's requests: unasked, repeated, missing, or why they are invalid."""
    asked = admissions(packets).where("request is not null").select("claim_id", "request")
    joined = labels.join(asked, "claim_id", "left")
    codes = F.when(F.col("request").isNull(), F.array(F.lit("unasked"))).when(F.col("response").isNull(), F.array(F.lit("no response"))).otherwise(selection_faults(F.col("response"), F.col("request")))
    again = labels.groupBy("claim_id").agg(F.count("*").alias("n")).where("n > 1").select("claim_id", F.lit("repeated").alias("fault"))
    missing = asked.join(labels.select("claim_id"), "claim_id", "left_anti").select("claim_id", F.lit("missing").alias("fault"))
    return joined.select("claim_id", F.explode(codes).alias("fault")).union(again).union(missing)


def executed(frozen: DataFrame, responses: DataFrame, limit: int = shadow.REQUESTS) -> DataFrame:
    """Observations of admitted claims (admissions() rows) and what a selector gave: file, claim_id, response, error, and the
    run's duration_ms, execution_policy, provider_id, model_id and tokens. The first `limit` requests of a file run, others are deferred."""
    turn = F.count("request").over(Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    rows = frozen.withColumn("turn", turn).join(responses, ["file", "claim_id"], "left")
    request, response = F.col("request"), F.col("response")
    wrong = selection_faults(response, request)
    ran = request.isNotNull() & (F.col("turn") <= limit)
    failed = F.col("error").isNotNull() | response.isNull()
    state = F.when(request.isNull(), F.when(F.col("state") == "blocked", "blocked").otherwise("empty")).when(~ran, "deferred").when(failed, "provider_error").when(F.size(wrong) > 0, "invalid_output").otherwise("accepted")
    whole = response.withField("rejected_evidence_ids", ordered(request, response["rejected_evidence_ids"])).withField("insufficient_evidence_ids", ordered(request, response["insufficient_evidence_ids"]))
    whole = whole.withField("unresolved_surfaces", _list(response["unresolved_surfaces"])).cast(SELECTION)
    good = F.col("execution_state") == "accepted"
    note = lambda code, message: F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))
    notes = F.when(F.col("execution_state") == "provider_error", F.array(note("shadow_provider_error", "The selector gave no answer."))).when(good, F.array())
    notes = notes.otherwise(F.transform(wrong, lambda c: F.struct(c.alias("code"), F.lit("The answer doesn't fit its request.").alias("message"))))
    answered = F.col("execution_state") != "provider_error"
    passed = lambda c: F.when(answered, F.col(c)).alias(c)
    run = F.struct(
        request["request_id"].alias("request_id"), request["subject_id"].alias("subject_id"), F.col("execution_state").alias("state"), F.size("request.candidates").alias("candidate_count"), F.greatest(F.coalesce("duration_ms", F.lit(0.0)), F.lit(0.0)).alias("duration_ms"),
        "execution_policy", passed("provider_id"), passed("model_id"), passed("input_tokens"), passed("output_tokens"), F.when(good, whole).alias("selection"),
        F.when(good, compared(request, F.col("deterministic_evidence_ids"), whole)).alias("comparison"), notes.cast(NOTES).alias("diagnostics"),
    )
    late = F.array(note("shadow_execution_budget_deferred", f"Deferred by the limit of {limit} requests.")).cast(NOTES)
    told = _list(F.col("diagnostics"), NOTES)
    done = rows.withColumn("execution_state", state)
    return done.select(
        "file", "ordinal", "claim_id", F.col("state").alias("admission_state"), "execution_state", "eligible_count", _list(F.col("deterministic_evidence_ids")).alias("deterministic_evidence_ids"), "request",
        F.when(F.col("execution_state").isin(*EXECUTED), run).alias("run"), F.when(F.col("execution_state") == "deferred", F.concat(told, late)).otherwise(told).alias("diagnostics"),
    )


def run_documents(claims: DataFrame, files: DataFrame) -> DataFrame:
    """file, schema_version, summary and observations of runs, in the format that executions() reads. A review's claims meet in one row."""
    fields = [c for c in claims.columns if c not in ("file", "ordinal")]
    listed = claims.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ordinal", "claim_id", F.struct(*fields).alias("o")))).alias("rows"))
    total = run_totals(claims, files)
    summary = F.struct(*[c for c in total.columns if c != "file"], F.lit(True).alias("artifact_written"))
    kind = f"array<struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in claims.select(*fields).schema)}>>"
    joined = total.select("file", summary.alias("summary")).join(listed, "file", "left")
    return joined.select("file", F.lit("llm_shadow_execution.v5").alias("schema_version"), "summary", F.coalesce(F.transform("rows", lambda r: r["o"]), F.array().cast(kind)).alias("observations"))
