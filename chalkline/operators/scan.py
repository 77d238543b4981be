"""Closure scans: whether what should be gone is still there, line by line, and what a limit left unread."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.paths import fact_profile
from chalkline.functions.selectors import inferred_selectors
from chalkline.operators.association import indexed
from chalkline.operators.stages import kept

#: Phrases that all lines are matched with at once.
PHRASES = 5_000
# Bounds of a scan, folders it leaves out, and the symbol tokens it matches.
MAX_FILES, MAX_BYTES, MAX_MATCHES = 2000, 8_000_000, 100
IGNORED_FOLDERS = (
    ".codegraph", ".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "vendor",
    "venv",
)
SYMBOL = r"[A-Za-z_][A-Za-z0-9_]*"
#: Words as selectors are bounded by; how much of a word's beginning is a key.
RUN, PREFIX = "[A-Za-z0-9_]+", 4


def quoted(value: Column) -> Column:
    """value as a pattern that matches itself."""
    return F.regexp_replace(value, r"([^A-Za-z0-9_\s])", r"\\$1")


def bounded_match(text: Column, selector: Column, phrase: Column) -> Column:
    """A phrase is found anywhere; anything else between characters that aren't of words. Case never matters."""
    word = F.concat(F.lit(r"(?i)(?:^|[^A-Za-z0-9_])"), quoted(selector), F.lit(r"(?:$|[^A-Za-z0-9_])"))
    return F.when(phrase, F.contains(F.lower(text), F.lower(selector))).otherwise(F.regexp_like(text, word))


def within_scopes(path: Column, scopes: Column) -> Column:
    """Without scopes every path is within; else one that any scope is found in."""
    return (F.size(scopes) == 0) | F.exists(scopes, lambda s: bounded_match(path, s, F.lit(False)))


def read_until(files: DataFrame, size: str, order: list[str], max_bytes: int = MAX_BYTES, bins: int = 1024) -> DataFrame:
    """files with within: those whose sizes, summed in order, stay in the limit up to and with them.

    Sums are first taken by ranges of the order's first column (a long), so no single task sees all files.
    """
    ends = files.agg(F.min(order[0]).alias("low"), F.max(order[0]).alias("high")).first()
    low, high = (ends["low"] or 0), (ends["high"] or 0)
    width = max(1, -(-(high - low + 1) // bins))
    rows = files.withColumn("bin", F.floor((F.col(order[0]) - low) / width).cast("int"))
    sums = rows.groupBy("bin").agg(F.sum(size).alias("bin_size"))
    before = sums.withColumn("before", F.coalesce(F.sum("bin_size").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most bins rows
    joined = rows.join(F.broadcast(before.select("bin", "before")), "bin")
    upto = F.col("before") + F.sum(size).over(Window.partitionBy("bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.withColumn("within", upto <= max_bytes).drop("bin", "before")


def scannable(path: Column) -> Column:
    """Whether no folder of the path is left out."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_FOLDERS)))


def selector_key(value: Column, phrase: Column) -> Column:
    """What a line must have for a selector to match: "=" and a whole word of it, or "^" and how one begins; null if neither is sure.

    A selector's words are whole in the text; of a phrase only those between others are, as its ends may be parts of longer
    words. A phrase of two words meets how its second word begins.
    """
    runs = F.regexp_extract_all(F.lower(value), F.lit(RUN), F.lit(0))
    begins, ends = (F.lower(value).rlike(x).cast("int") for x in (r"^[A-Za-z0-9_]", r"[A-Za-z0-9_]$"))
    whole = F.when(phrase, F.slice(runs, begins + 1, F.greatest(F.size(runs) - begins - ends, F.lit(0)))).otherwise(F.transform(F.regexp_extract_all(value, F.lit(RUN), F.lit(0)), F.lower))
    longest = F.aggregate(whole, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    last = F.element_at(runs, -1)
    opens = (F.size(runs) >= 2) | ((F.size(runs) == 1) & (begins == 0))
    return F.when(F.size(whole) > 0, F.concat(F.lit("="), longest)).when(phrase & opens, F.concat(F.lit("^"), F.substring(last, 1, PREFIX)))


def line_keys(content: Column, prefixes: bool) -> Column:
    """The keys that selectors can meet a line by; prefixes: the beginnings of words too."""
    own = F.regexp_extract_all(F.lower(content), F.lit(RUN), F.lit(0))
    # characters beyond ASCII may become ASCII letters in lower case, which selectors of words don't see
    raw = F.transform(F.regexp_extract_all(content, F.lit(RUN), F.lit(0)), F.lower)
    words = F.array_distinct(F.when(content.rlike(r"^[\x00-\x7f]*$"), own).otherwise(F.concat(own, raw)))
    whole = F.transform(words, lambda w: F.concat(F.lit("="), w))
    if not prefixes:
        return whole
    begun = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.lit(PREFIX)), lambda n: F.concat(F.lit("^"), F.substring(w, F.lit(1), n)))))
    return F.array_distinct(F.concat(whole, begun))


def selector_hits(lines: DataFrame, selectors: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, content, any columns) with the selectors (keys, value, phrase, any columns) that match them.

    One pass over the lines: each meets selectors by its words, so lines times selectors are never compared. Selectors without
    a sure word (signs, parts of one word) meet all lines of their keys, without keys in blocks of PHRASES.
    """
    wanted = selectors.withColumn("_key", selector_key(F.col("value"), F.col("phrase")))
    count = {r[0]: r[1] for r in wanted.groupBy(F.coalesce(F.substring("_key", 1, 1), F.lit(""))).count().collect()}
    match = bounded_match(F.col("content"), F.col("value"), F.col("phrase"))
    keyed = lines.withColumn("_key", F.explode(line_keys(F.col("content"), "^" in count)))
    out = keyed.join(indexed(wanted.where("_key is not null"), sum(count.values())), [*keys, "_key"]).where(match).drop("_key")
    if not count.get(""):
        return out
    loose = wanted.where("_key is null").drop("_key")
    if keys:
        return out.unionByName(lines.join(indexed(loose, count[""]), keys).where(match))
    blocks = -(-count[""] // PHRASES)
    for k in range(blocks):
        block = F.broadcast(loose.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == k))  # some PHRASES rows
        out = out.unionByName(lines.join(block, match))
    return out


def line_matches(files: DataFrame, selectors: DataFrame, file_key: str, selector_key: str) -> DataFrame:
    """file_key, selector_key and line (from 1) of lines of files (text) that match a selector (value, phrase)."""
    lines = files.select(file_key, F.posexplode(F.split("text", "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)
    return selector_hits(lines, selectors.select(selector_key, "value", "phrase"), []).select(file_key, selector_key, "line")


def capped_matches(matches: DataFrame, plan: str, order: list[str], limit: int = MAX_MATCHES) -> DataFrame:
    """The first matches of each plan in order."""
    return matches.withColumn("place", F.row_number().over(Window.partitionBy(plan).orderBy(*order))).where(F.col("place") <= limit)


def scan_coverage(plans: DataFrame, files: DataFrame, plan: str) -> DataFrame:
    """plan, inspected_count, inspected_bytes and state (partial if a file is not within the limits; unavailable without files)."""
    counted = files.agg(F.count_if("within").alias("inspected_count"), F.coalesce(F.sum(F.when(F.col("within"), F.col("size"))), F.lit(0)).alias("inspected_bytes"), F.count("*").alias("files"))
    state = F.when(F.col("files") == 0, "unavailable").when(F.col("inspected_count") < F.col("files"), "partial").otherwise("complete")
    return plans.select(plan).crossJoin(F.broadcast(counted)).select(plan, "inspected_count", "inspected_bytes", state.alias("state"))  # one row


def scan_plans(statements: DataFrame) -> DataFrame:
    """A plan for each side of a guardrail, a removal and a negative completion condition (statement_id, kind, text, expectation).

    Removals scan both revisions and expect a transition, the others the head and absence.
    """
    wanted = statements.where(F.col("kind").isin("guardrail", "removal") | ((F.col("kind") == "completion_condition") & (F.col("expectation") == "absent_head")))
    removal = F.col("kind") == "removal"
    sides = F.when(removal, F.array(F.lit("base"), F.lit("head"))).otherwise(F.array(F.lit("head")))
    expects = F.when(removal, "transition").otherwise("absence")
    return wanted.select(F.concat(F.lit("CSP:"), "statement_id").alias("plan_id"), "statement_id", "kind", expects.alias("expectation"), F.explode(sides).alias("revision_side"))


def authored_candidates(predicates: DataFrame) -> DataFrame:
    """plan_id, place, role, kind, value and source_predicate_id of claims' predicates (claim_id, predicate_id, selector_kind,
    values, role, n); ordered paths select nothing."""
    kind = F.when(F.col("selector_kind") == "repository_path", "path").otherwise("identifier")
    return predicates.where("selector_kind <> 'ordered_path'").select(
        F.concat(F.lit("CSP:"), "claim_id").alias("plan_id"), F.col("n").alias("place"), "role", kind.alias("kind"), F.col("values")[0].alias("value"), F.col("predicate_id").alias("source_predicate_id")
    )


def inferred_candidates(guardrails: DataFrame) -> DataFrame:
    """The same of guardrails' prose (statement_id, text): all are targets that no predicate is behind."""
    found = guardrails.select(F.concat(F.lit("CSP:"), "statement_id").alias("plan_id"), F.posexplode(inferred_selectors(F.col("text"))).alias("place", "s"))
    return found.select("plan_id", "place", F.lit("target").alias("role"), "s.kind", "s.value", F.lit(None).cast("string").alias("source_predicate_id"))


def scan_predicates(candidates: DataFrame) -> DataFrame:
    """plan_id, predicate_id, kind, value, scopes and source_predicate_id of a plan's distinct targets, numbered in order.

    Every target is looked for within all of the plan's path scopes; a plan with scopes has no phrases.
    """
    scoped = candidates.where("role = 'path_scope' and kind = 'path'").groupBy("plan_id", "value").agg(F.min("place").alias("place"))
    scopes = scoped.groupBy("plan_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("scopes"))
    targets = candidates.where("role = 'target'").groupBy("plan_id", "kind", "value", "source_predicate_id").agg(F.min("place").alias("place"))
    joined = targets.join(scopes, "plan_id", "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>")))
    kept = joined.where("size(scopes) = 0 or kind <> 'phrase'")
    number = F.row_number().over(Window.partitionBy("plan_id").orderBy("place", "kind", "value", "source_predicate_id"))
    return kept.withColumn("number", number).select("plan_id", F.concat_ws(":predicate:", "plan_id", F.col("number").cast("string")).alias("predicate_id"), "number", "kind", "value", "scopes", "source_predicate_id")


def scan_refusal(side: Column, has_root: Column, revision: Column, expected: Column, clean: Column, n_predicates: Column) -> Column:
    """Why a plan isn't scanned on a side; null if it is. A checkout must be there, at the reviewed revision and without changes."""
    stale = (F.coalesce(revision, F.lit("")) == "") | ((F.coalesce(expected, F.lit("")) != "") & (revision != expected))
    return (
        F.when(~has_root, F.when(side == "base", "closure_scan_base_input_missing").otherwise("closure_scan_head_input_missing"))
        .when(stale, "closure_scan_stale_checkout")
        .when(~clean, "closure_scan_dirty_checkout")
        .when(n_predicates == 0, "closure_scan_no_executable_selector")
    )


def scanned_paths(files: DataFrame, keys: list[str], max_files: int = MAX_FILES) -> DataFrame:
    """The first max_files files of each checkout (keys; path, its own) by path, and file_limited: whether there are more.

    Paths are ordered without texts, which few checkouts would bring to as few tasks; texts are then met by their paths.
    """
    order = Window.partitionBy(*keys).orderBy("path")
    first = files.where(scannable(F.col("path"))).select(*keys, "path").withColumn("path_place", F.row_number().over(order)).where(F.col("path_place") <= max_files + 1)
    more = F.max("path_place").over(Window.partitionBy(*keys)) > max_files
    placed = first.withColumn("file_limited", more).where(F.col("path_place") <= max_files)
    placed = kept(placed.groupBy(*keys, "path").agg(F.min("path_place").alias("path_place"), F.first("file_limited").alias("file_limited")))
    return files.join(indexed(placed, placed.count()), [*keys, "path"])


def plan_readings(predicates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, plan_id and readings (the distinct scopes) of what a plan's predicates read; paths are read by nobody."""
    return predicates.where("kind <> 'path'").groupBy(*keys, "plan_id").agg(F.array_sort(F.collect_set("scopes")).alias("readings"))


def read_files(files: DataFrame, readings: DataFrame, keys: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """keys, readings, path, size and fits of the files that plans of these readings look into, by path until max_bytes.

    Plans of equal readings read the same files, so these are dealt once for each; texts stay where they are. Files that
    can't be read (null text, a NUL at the beginning) aren't.
    """
    readable = F.col("text").isNotNull() & ~F.contains(F.substring("text", 1, 4096), F.lit("\0"))
    sizes = files.where(readable).select(*keys, "path", F.octet_length("text").alias("size"))
    met = sizes.join(readings.select(*keys, "readings").distinct(), keys).where(F.exists("readings", lambda scopes: within_scopes(F.col("path"), scopes)))
    upto = F.sum("size").over(Window.partitionBy(*keys, "readings").orderBy("path"))
    return met.withColumn("fits", upto <= max_bytes)


def surface_matches(files: DataFrame, predicates: DataFrame, keys: list[str], max_bytes: int = MAX_BYTES, max_matches: int = MAX_MATCHES) -> tuple[DataFrame, DataFrame]:
    """Matches of plans on three surfaces, and how far each plan was scanned.

    files: of scanned_paths(), with text (null if it can't be read); predicates: keys and the columns of scan_predicates().
    Paths come first, then file after file: its lines' contents, then their symbol names. Of a plan the first max_matches
    count; contents are read until max_bytes. Every text is cut into lines once, whatever predicates look at it, and lines
    meet predicates by their words (selector_hits); paths do so too.
    """
    whole = [*keys, "plan_id"]
    scoped = predicates.select(*whole, "predicate_id", "number", "kind", "value", "scopes", (F.col("kind") == "phrase").alias("phrase"))
    named = selector_hits(files.select(*keys, "path", F.col("path").alias("content")), scoped.where("kind = 'path'"), keys).where(within_scopes(F.col("path"), F.col("scopes")))
    columns = [*whole, "predicate_id", "number", "surface", "path", "line", "excerpt", "turn", "at"]
    named = named.select(*whole, "predicate_id", "number", F.lit("paths").alias("surface"), "path", F.lit(0).alias("line"), F.col("path").alias("excerpt"), F.lit(0).alias("turn"), F.lit(0).alias("at"))
    readings = kept(plan_readings(predicates, keys))
    reads = kept(read_files(files, readings, keys, max_bytes))
    open_ = files.join(reads.where("fits").select(*keys, "path").distinct(), [*keys, "path"], "left_semi")
    lines = open_.select(*keys, "path", F.posexplode(F.split("text", "\r\n|[\n\r]", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)
    hits = selector_hits(lines, scoped.where("kind <> 'path'").join(readings, whole), keys).where(within_scopes(F.col("path"), F.col("scopes")))
    hits = hits.join(reads.where("fits").select(*keys, "readings", "path"), [*keys, "readings", "path"], "left_semi")
    hits = kept(hits.select(*whole, "predicate_id", "number", "kind", "value", "path", "line", "content"))
    contents = hits.select(*whole, "predicate_id", "number", F.lit("file_content").alias("surface"), "path", "line", F.substring(F.trim("content"), 1, 240).alias("excerpt"), F.lit(1).alias("turn"), F.lit(0).alias("at"))
    # a symbol that is the selector stands between characters that aren't of words, so its line is a hit
    symbols = hits.where("kind = 'identifier'").select("*", F.posexplode(F.regexp_extract_all("content", F.lit(SYMBOL), F.lit(0))).alias("at", "symbol")).where(F.lower("symbol") == F.lower("value"))
    symbols = symbols.select(*whole, "predicate_id", "number", F.lit("symbol_names").alias("surface"), "path", "line", F.col("symbol").alias("excerpt"), F.lit(2).alias("turn"), "at")
    found = reduce(DataFrame.union, [part.select(*columns) for part in (named, contents, symbols)])
    order = Window.partitionBy(*whole).orderBy(F.col("turn") > 0, "path", "line", "turn", "at", "number")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_matches)
    identity = F.concat_ws("\0", "plan_id", "predicate_id", "revision_side" if "revision_side" in keys else F.lit("head"), F.concat("predicate_id", F.lit(":target")), "surface", "path", F.col("line").cast("string"))
    rows = kept(found.select(*whole, "predicate_id", F.concat(F.lit("CSM:"), F.substring(F.sha2(identity, 256), 1, 16)).alias("match_id"), "surface", "path", F.nullif("line", F.lit(0)).alias("line"), "excerpt", fact_profile(F.col("path")).alias("profile"), "place"))
    plans = predicates.select(*whole).distinct().join(files.groupBy(*keys).agg(F.count("*").alias("n_paths"), F.bool_or("file_limited").alias("file_limited")), keys, "left")
    sizes = reads.groupBy(*keys, "readings").agg(F.bool_or(~F.col("fits")).alias("byte_limited"), F.count_if("fits").alias("n_files"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("n_bytes"))
    read = readings.join(sizes, [*keys, "readings"])
    n_matches = rows.groupBy(*whole).agg(F.count("*").alias("n_matches"))
    states = plans.join(read.drop("readings"), whole, "left").join(n_matches, whole, "left").na.fill(0, ["n_paths", "n_files", "n_bytes", "n_matches"]).na.fill(False, ["file_limited", "byte_limited"])
    limited = F.col("file_limited") | F.col("byte_limited") | (F.col("n_matches") >= max_matches)
    return rows, states.select(*whole, "n_paths", "n_files", "n_bytes", "n_matches", F.when(F.col("n_paths") == 0, "unavailable").when(limited, "partial").otherwise("complete").alias("state"))


def checked_scans(checkouts: DataFrame, files: DataFrame, plans: DataFrame, predicates: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """Matches, and for each plan and side its state with the refusal if it wasn't scanned.

    checkouts: review_id, revision_side, has_root, revision, expected, clean; files: review_id, revision_side, path, text; plans:
    review_id, plan_id, statement_id, revision_side; predicates: review_id, plan_id and the columns of scan_predicates(). A
    refused checkout's files aren't read.
    """
    keys = ["review_id", "revision_side"]
    counted = predicates.groupBy("review_id", "plan_id").agg(F.count("*").alias("n_predicates"))
    told = plans.join(checkouts, keys, "left").join(counted, ["review_id", "plan_id"], "left").na.fill(0, ["n_predicates"]).na.fill(False, ["has_root", "clean"])
    refusal = scan_refusal(F.col("revision_side"), F.col("has_root"), F.col("revision"), F.col("expected"), F.col("clean"), F.col("n_predicates"))
    told = kept(told.select(*keys, "plan_id", "statement_id", refusal.alias("refusal")))
    allowed = told.where("refusal is null").select(*keys, "plan_id")
    open_ = files.join(allowed.select(*keys).distinct(), keys, "left_semi")
    rows, states = surface_matches(scanned_paths(open_, keys), allowed.join(predicates, ["review_id", "plan_id"]), keys, **limits)
    shown = told.join(states, [*keys, "plan_id"], "left").na.fill(0, ["n_paths", "n_files", "n_bytes", "n_matches"])
    return rows, shown.withColumn("state", F.coalesce("state", F.lit("unavailable")))


def closure_evidence(states: DataFrame, sides: list[str]) -> DataFrame:
    """plan columns, n_matches and summary: one fact for all sides of a plan's scan, side by side in the order of names.

    states: plan_id, revision_side, n_matches and state.
    """
    said = F.struct("revision_side", F.concat_ws(": ", "revision_side", "state").alias("text"))
    folded = states.where(F.col("revision_side").isin(*sides)).groupBy("plan_id").agg(F.sum("n_matches").alias("n_matches"), F.sort_array(F.collect_list(said)).alias("said"))
    return folded.select("plan_id", "n_matches", F.array_join(F.transform("said", lambda x: x["text"]), "; ").alias("summary"))


def unavailable_results(plans: DataFrame, message: str) -> DataFrame:
    """What is said of plans that nothing scanned."""
    return plans.select("plan_id", "statement_id", "revision_side", F.lit("unavailable").alias("state"), F.lit(0).alias("inspected_count"), F.lit(message).alias("message"))
