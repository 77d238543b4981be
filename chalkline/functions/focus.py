"""What a review focus asks for, and which facts it admits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions import vocabulary as V
from chalkline.functions.lexical import merge_signatures, semantic_tokens


def _has(tokens: Column, words) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def requirement_profile(kind: Column, text: Column, tokens: Column) -> Column:
    plain = F.lower(F.trim(text))
    out = F.lit("generic")
    for name, words in reversed(V.PROFILE_TERMS):
        out = F.when(_has(tokens, words), name).otherwise(out)
    out = F.when(plain.rlike(V.TEST_INTENT), "test_verification").otherwise(out)
    out = F.when(plain.rlike(V.DOCUMENTATION_INTENT), "documentation").otherwise(out)
    return F.when(kind == "guardrail", "guardrail").otherwise(out)


def asks_removal(tokens: Column) -> Column:
    return _has(tokens, V.REMOVAL_TERMS)


def admissions(spark) -> DataFrame:
    """focus_profile and profile of facts it admits: a few dozen fixed rows."""
    return spark.createDataFrame([(k, v) for k, vs in V.ADMITTED.items() for v in vs], "focus_profile string, admitted_profile string")


def evidence_role(focus_profile: Column, fact_profile: Column) -> Column:
    return (
        F.when((fact_profile == "document") & (focus_profile != "documentation"), "document_support")
        .when((fact_profile == "test") & (focus_profile != "test_verification"), "test_support")
        .otherwise("primary")
    )


def directional_signature(head: Column, base: Column, side: Column, guardrail: Column, removal: Column) -> Column:
    """The head's signature, and the base's too for base facts, guardrails and wording of removal."""
    return F.when((side == "base") | guardrail | removal, merge_signatures(head, base)).otherwise(head)


def focus_tokens(text: Column) -> Column:
    return semantic_tokens(text)
