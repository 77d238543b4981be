"""Classes of file paths as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions import vocabulary as V


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _normal(path: Column) -> Column:
    return F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(_normal(path), r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The last dot and what follows, unless the dot is the name's first or last character."""
    return F.regexp_extract(file_name(path), r"^.+?(\.[^.]+)$", 1)


def is_test_path(path: Column) -> Column:
    p, name = _normal(path), file_name(path)
    return _any([p.startswith("test/"), p.startswith("tests/"), p.contains("/test/"), p.contains("/tests/"), name.startswith("test_"), *[name.endswith(x) for x in V.TEST_ENDINGS]])


def path_classification(path: Column) -> Column:
    return F.when(is_test_path(path), "test").when(suffix(path).isin(*V.DOCUMENT_SUFFIXES), "document").otherwise("code")


def fact_profile(path: Column) -> Column:
    p, name, end = _normal(path), file_name(path), suffix(path)
    return (
        F.when(is_test_path(path), "test")
        .when(end.isin(*V.DOCUMENT_SUFFIXES), "document")
        .when(_any([p.startswith(x) for x in V.WORKFLOW_FOLDERS]), "workflow")
        .when(name.isin(*V.DEPENDENCY_NAMES), "dependency")
        .when(name.isin(*V.CONFIGURATION_NAMES) | end.isin(*V.CONFIGURATION_SUFFIXES), "configuration")
        .when(p.contains("migration") | p.contains("schema"), "schema")
        .when(F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, V.GENERATED_FOLDERS))), "generated")
        .otherwise("production")
    )


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(path, F.lit(""))), "/"), lambda x: (x != "") & (x != "."))


def architectural_layer(path: Column) -> Column:
    parts = _parts(path)
    stem = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"^(.+)\.[^.]+$", "$1")
    segments = F.concat(parts, F.array(stem))
    layer = F.lit(None).cast("string")
    for name, words in reversed(V.LAYERS):
        layer = F.when(F.arrays_overlap(segments, F.array(*map(F.lit, words))), name).otherwise(layer)
    return F.when(F.size(parts) == 0, "unclassified").otherwise(F.coalesce(layer, F.lit("unclassified")))


def architectural_domain(path: Column) -> Column:
    parts = _parts(path)
    first = F.try_element_at(parts, F.lit(1))
    inner = F.slice(parts, F.lit(2), F.greatest(F.least(F.size(parts) - 2, F.lit(2)), F.lit(0)))
    below = F.when(F.size(parts) > 2, F.array_join(inner, "/")).otherwise(F.coalesce(F.try_element_at(parts, F.lit(2)), first))
    return F.when(first.isNull(), "unclassified").when(first.isin(*V.OWN_DOMAINS), first).when(first.isin(*V.SOURCE_ROOTS), below).otherwise(first)


def is_structural(path: Column) -> Column:
    """Whether code graphs cover the file: by suffix, by a few names, and JSON below templates or sections."""
    p, name, end = _normal(path), file_name(path), suffix(path)
    folders = F.slice(F.split(p, "/"), F.lit(1), F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    return (
        F.when(_any([p == "conf/routes", *[name.endswith(x) for x in V.STRUCTURAL_ENDS]]), True)
        .when(name.startswith("application") & end.isin(".yml", ".yaml"), True)
        .when(end == ".json", F.arrays_overlap(folders, F.array(F.lit("templates"), F.lit("sections"))))
        .otherwise(end.isin(*V.STRUCTURAL_SUFFIXES))
    )


def path_kind(paths: Column) -> Column:
    """test, runtime or mixed of the files along a path (an array; an empty one is mixed)."""
    some, every = F.exists(paths, is_test_path), F.forall(paths, is_test_path)
    return F.when((F.size(paths) > 0) & every, "test").when((F.size(paths) > 0) & ~some, "runtime").otherwise("mixed")
