"""Selectors of claims and what they match; links; small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions.lexical import identifier_keys, merged

# Words at a clause's edges that are no part of a phrase, and what ends a clause.
EDGE_WORDS = (
    "a", "add", "an", "any", "be", "do", "does", "executing", "defining", "declaring", "emitting", "introduce", "keep", "must", "no", "not", "remain",
    "remains", "the", "to",
)
CLAUSE_BREAK = r"(?i)\s*(?:[,;，；]|\bor\b|\band\b|\bwithout\b|\bnor\b)\s*"
CLAUSE_WORD = r"[A-Za-z][A-Za-z0-9_.:/-]*"
# Roles of facts in transformations, and suffixes of files that code graphs cover.
STRUCTURAL_ROLES = ("change", "relation_change", "ownership_change", "structural_path")
BASE_SIDE, HEAD_SIDE = ("present_base", "absent_head"), ("present_head", "verified_head")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"^\./", "")


def selector_keys(value: Column) -> Column:
    """Identifier keys of a selector and its last part, letters and digits only, of three characters or more."""
    explicit = F.regexp_replace(F.trim(value), r"\(\)$", "")
    leaf = F.lower(F.regexp_replace(F.element_at(F.split(explicit, "[.:]"), -1), "[^A-Za-z0-9_]", ""))
    return merged(identifier_keys(explicit), F.when(F.length(leaf) >= 3, F.array(leaf)).otherwise(F.array().cast("array<string>")))


def candidate_keys(expectation: Column, base: Column, head: Column) -> Column:
    """The keys of a fact that a predicate looks at: its side's identifiers and tokens; references see identifiers of both."""
    every = lambda s: F.concat(s["identifiers"], s["tokens"])
    return F.when(expectation.isin(*BASE_SIDE), every(base)).when(expectation.isin(*HEAD_SIDE), every(head)).otherwise(merged(base["identifiers"], head["identifiers"]))


def candidate_paths(expectation: Column, path: Column, base_path: Column, head_path: Column) -> Column:
    wanted = F.when(expectation.isin(*BASE_SIDE), F.array(base_path)).when(expectation.isin(*HEAD_SIDE), F.array(head_path)).otherwise(F.array(path, base_path, head_path))
    return F.array_distinct(F.transform(F.filter(F.array_compact(wanted), lambda p: F.trim(p) != ""), normal_path))


def selector_matches(kind: Column, value: Column, paths: Column, keys: Column, is_check: Column, check_name: Column, selector_name: Column) -> Column:
    """A path selector matches its path and below; checks match by name; all else by a common key."""
    own = F.regexp_replace(normal_path(value), "/+$", "")
    below = F.exists(paths, lambda p: (p == own) | p.startswith(F.concat(own, F.lit("/"))))
    named = (selector_name != "") & (selector_name == check_name)
    return F.when(kind == "repository_path", below).when(is_check, F.coalesce(named, F.lit(False))).otherwise(F.arrays_overlap(selector_keys(value), keys))


def eligible_evidence(claim_kind: Column, role: Column, profile: Column, operation: Column, base_keys: Column, head_keys: Column) -> Column:
    """Whether a fact may speak for a claim of a kind."""
    within = lambda *roles: role.isin(*roles)
    rules = {
        "test_migration": (profile == "test") & within("change", "structural_path"),
        "production_path": (profile == "production") | within("relation_change", "ownership_change", "structural_path"),
        "before_topology": F.size(base_keys) > 0,
        "after_topology": F.size(head_keys) > 0,
        "removal": within("change", "relation_change", "ownership_change") & (operation.isin("removed", "replaced", "unresolved") | (F.size(base_keys) > 0)),
        "completion_condition": within(*STRUCTURAL_ROLES, "verification"),
        "authority": within("change", "relation_change", "ownership_change"),
    }
    silent = role.isNull() | claim_kind.isin("before_state", "after_state", "uncertainty")
    out = within(*STRUCTURAL_ROLES)
    for kind, rule in rules.items():
        out = F.when(claim_kind == kind, rule).otherwise(out)
    return F.when(silent, False).otherwise(F.coalesce(out, F.lit(False)))


def eligible_candidate(claim_kind: Column, role: Column, profile: Column, operation: Column, base_keys: Column, head_keys: Column) -> Column:
    """eligible_evidence() for outside selectors, who may be asked about states: any fact of that revision speaks for one."""
    own = eligible_evidence(claim_kind, role, profile, operation, base_keys, head_keys)
    return F.when(claim_kind == "before_state", F.size(base_keys) > 0).when(claim_kind == "after_state", F.size(head_keys) > 0).otherwise(own)


def inferred_selectors(text: Column) -> Column:
    """Array of (kind, value) from prose: a clause's identifiers, or its first four words as a phrase."""
    edge = lambda w: F.lower(w).isin(*EDGE_WORDS)
    trimmed = lambda w: F.btrim(w, F.lit(".,;:()[]{}"))

    def clause(c: Column) -> Column:
        words = F.filter(F.transform(F.regexp_extract_all(c, F.lit(CLAUSE_WORD), F.lit(0)), trimmed), lambda w: w != "")
        inner = F.filter(F.transform(words, lambda w, i: F.when(~edge(w), i)), lambda i: i.isNotNull())
        kept = F.when(F.size(inner) > 0, F.slice(words, F.array_min(inner) + 1, F.array_max(inner) - F.array_min(inner) + 1)).otherwise(F.array().cast("array<string>"))
        marked = F.filter(kept, lambda w: w.rlike("[_./-]") | w.rlike("[a-z][A-Z]"))
        kind = lambda w: F.when(w.contains("/") | w.contains("\\"), "path").when(w.rlike(r"^[A-Za-z_][A-Za-z0-9_.:-]*$"), "identifier").otherwise("phrase")
        named = F.transform(marked, lambda w: F.struct(kind(w).alias("kind"), w.alias("value")))
        phrase = F.array(F.struct(F.lit("phrase").alias("kind"), F.lower(F.array_join(F.slice(kept, 1, 4), " ")).alias("value")))
        return F.when(F.size(marked) > 0, named).when(F.size(kept) >= 2, phrase).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))

    return F.flatten(F.transform(F.split(text, CLAUSE_BREAK, -1), clause))


def safe_href(url: Column) -> Column:
    """The url if it is absolute http or https with a host, else null."""
    return F.when(url.rlike(r"(?i)^https?://[^/\s?#]+"), url)


def blob_link(repository_url: Column, revision: Column, path: Column, first: Column, last: Column) -> Column:
    lines = F.when(first.isNull(), "").when(last.isNull() | (last == first), F.concat(F.lit("#L"), first.cast("string"))).otherwise(F.concat(F.lit("#L"), first.cast("string"), F.lit("-L"), last.cast("string")))
    return F.concat(repository_url, F.lit("/blob/"), revision, F.lit("/"), path, lines)


def located(source: Column, root: Column, repository: Column, revision: Column) -> Column:
    """A source (label, url, path, line_start, line_end) with the link to its lines, if it has a path and no url yet."""
    link = blob_link(F.concat(root, F.lit("/"), repository), revision, F.replace(F.url_encode(source["path"]), F.lit("%2F"), F.lit("/")), source["line_start"], source["line_end"])
    bare = F.coalesce(source["path"] != "", F.lit(False)) & (F.coalesce(source["url"], F.lit("")) == "")
    return F.struct(source["label"].alias("label"), F.when(bare, F.replace(link, F.lit("+"), F.lit("%20"))).otherwise(source["url"]).alias("url"), source["path"].alias("path"), source["line_start"].alias("line_start"), source["line_end"].alias("line_end"))


def diff_link(review_url: Column, path: Column, side: Column, line: Column) -> Column:
    """A change's place in the review: files are named by the digest of their path."""
    mark = F.when(side == "base", "L").otherwise("R")
    return F.concat(review_url, F.lit("/files#diff-"), F.sha2(path.cast("binary"), 256), F.when(line.isNull(), "").otherwise(F.concat(mark, line.cast("string"))))


def focus_order(statement_id: Column, kinds: tuple[str, ...] = ("R", "G", "O", "S", "V", "C", "B", "VC", "T", "CC")) -> Column:
    """Struct to order statement ids by: kind, then number."""
    prefix = F.regexp_extract(statement_id, "^([A-Z]+)", 1)
    rank = F.array_position(F.array(*map(F.lit, kinds)), prefix)
    return F.struct(F.when(rank > 0, rank).otherwise(len(kinds) + 1).alias("rank"), F.regexp_extract(statement_id, "([0-9]+)$", 1).try_cast("int").alias("number"), statement_id.alias("id"))
