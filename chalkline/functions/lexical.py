"""Tokens, identifiers and signatures of texts as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.vocabulary import STOP_WORDS

WORD = r"[A-Za-z][A-Za-z0-9_]{2,}"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def semantic_tokens(text: Column) -> Column:
    """Sorted distinct tokens of four characters or more, words and their parts between underscores, without stop words.

    Words are ASCII here; case-insensitive matching that also takes the long s and the Kelvin sign is left out.
    """
    lowered = F.transform(F.array_distinct(_words(text)), lambda w: F.lower(w))
    parts = F.flatten(F.transform(lowered, lambda w: F.concat(F.array(w), F.split(w, "_", -1))))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 4) & ~t.isin(*STOP_WORDS))))


def identifier_keys(text: Column) -> Column:
    """Sorted distinct keys of words shaped as identifiers: all parts joined, and every suffix of parts, of five characters or more."""
    shaped = F.filter(F.array_distinct(_words(text)), lambda w: w.contains("_") | F.substring(w, 2, 1 << 20).rlike("[A-Z]"))
    parts = F.transform(shaped, lambda w: F.filter(F.split(F.lower(w), "_", -1), lambda p: (F.length(p) >= 3) | p.rlike("^[0-9]+$")))
    tails = F.flatten(F.transform(F.filter(parts, lambda p: F.size(p) > 0), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ""))))
    return F.array_sort(F.array_distinct(F.filter(tails, lambda k: F.length(k) >= 5)))


def merged(*arrays: Column) -> Column:
    """Sorted distinct union of token arrays."""
    return F.array_sort(F.array_distinct(reduce(lambda a, b: F.concat(a, b), arrays)))


def association_signature(*texts: Column) -> Column:
    """Struct of identifiers and tokens of all texts together."""
    return F.struct(merged(*[identifier_keys(t) for t in texts]).alias("identifiers"), merged(*[semantic_tokens(t) for t in texts]).alias("tokens"))


def merge_signatures(*signatures: Column) -> Column:
    return F.struct(merged(*[s["identifiers"] for s in signatures]).alias("identifiers"), merged(*[s["tokens"] for s in signatures]).alias("tokens"))


def each(rows: DataFrame, array: Column | str, name: str, *keep) -> DataFrame:
    """keep and a row for each element of array, as name; nulls are left out.

    An outer explode and a filter: for a plain explode Spark adds a filter on the array's size below it, which computes
    costly arrays twice.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def distinctive_terms(rows: DataFrame, keys: list[str], tokens: str = "tokens", corpus: list[str] = ()) -> DataFrame:
    """keys and term for every token that at most half of the distinct token sets of its corpus have (one at least).

    corpus: the columns that set corpora apart; none for a single one. Sets are counted once, however many rows have them.
    """
    corpus = list(corpus)
    sets = rows.select(*corpus, F.array_sort(F.array_distinct(tokens)).alias("set")).distinct()
    sizes = sets.groupBy(*corpus).agg(F.greatest(F.floor(F.count("*") / 2), F.lit(1)).alias("most"))
    frequency = each(sets, "set", "term", *corpus).groupBy(*corpus, "term").agg(F.count("*").alias("sets_with"))
    kept = frequency.join(sizes, corpus) if corpus else frequency.crossJoin(F.broadcast(sizes))  # one row
    kept = kept.where("sets_with <= most").select(*corpus, "term")
    own = each(rows, F.array_distinct(tokens), "term", *dict.fromkeys([*corpus, *keys]))
    return own.join(kept, [*corpus, "term"]).select(*dict.fromkeys([*corpus, *keys]), "term")
