"""Strict reading of JSON documents: what a schema doesn't know, or knows as another type, is a row with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegralType, MapType, StringType, StructType

FAULTS = "array<struct<path:string,fault:string>>"
NOTHING = f"cast(array() as {FAULTS})"
DEEP = (ArrayType, StructType, MapType)


def _word(kind: DataType) -> tuple[str, str]:
    """The pattern that a JSON value's own type must match, and its name for people."""
    if isinstance(kind, StringType):
        return "^(VOID|STRING)", "a string"
    if isinstance(kind, IntegralType):
        return "^(VOID|BIGINT)", "a whole number"
    if isinstance(kind, DoubleType):
        return "^(VOID|BIGINT|DOUBLE|DECIMAL|FLOAT)", "a number"
    if isinstance(kind, ArrayType):
        return "^(VOID|ARRAY)", "a list"
    if isinstance(kind, StructType | MapType):
        return "^(VOID|OBJECT)", "an object"
    return "^(VOID|BOOLEAN)", "a boolean"


def _object(fields: str, kind: StructType, path: str, depth: int) -> str:
    """Faults of an object's fields: unknown ones, plain ones in one sweep over their names, and what lies deeper."""
    names = ", ".join(f"'{f.name}'" for f in kind.fields)
    parts = [f"transform(array_sort(array_except(map_keys({fields}), array({names}))), k -> named_struct('path', concat_ws('.', {path}, k), 'fault', 'unknown field'))"]
    plain = ", ".join("struct('{}' as name, '{}' as pattern, '{}' as word)".format(f.name, *_word(f.dataType)) for f in kind.fields if not isinstance(f.dataType, DEEP))
    if plain:
        wrong = f"filter(array({plain}), s -> not regexp_like(coalesce(schema_of_variant({fields}[s.name]), 'VOID'), s.pattern))"
        parts.append(f"transform({wrong}, s -> named_struct('path', concat_ws('.', {path}, s.name), 'fault', concat('not ', s.word)))")
    parts += [_faults(f"{fields}['{f.name}']", f.dataType, f"concat_ws('.', {path}, '{f.name}')", depth) for f in kind.fields if isinstance(f.dataType, DEEP)]
    return f"concat({', '.join(parts)})"


def _inside(value: str, kind: DataType, path: str, depth: int) -> str:
    """Faults within a value that has the kind's outer form."""
    x, i = f"x{depth}", f"i{depth}"
    if isinstance(kind, ArrayType):
        return f"flatten(transform(cast({value} as array<variant>), ({x}, {i}) -> {_faults(x, kind.elementType, f"concat({path}, '[', {i}, ']')", depth + 1)}))"
    fields = f"cast({value} as map<string,variant>)"
    if isinstance(kind, MapType):
        return f"flatten(transform(map_entries({fields}), {x} -> {_faults(f'{x}.value', kind.valueType, f"concat_ws('.', {path}, {x}.key)", depth + 1)}))"
    if isinstance(kind, StructType):
        return f"flatten(transform(array({fields}), {x} -> {_object(x, kind, path, depth + 1)}))"
    return NOTHING


def _faults(value: str, kind: DataType, path: str, depth: int) -> str:
    pattern, name = _word(kind)
    own = f"coalesce(schema_of_variant({value}), 'VOID')"
    return f"case when {own} = 'VOID' then {NOTHING} when {own} rlike '{pattern}' then {_inside(value, kind, path, depth)} else array(named_struct('path', {path}, 'fault', 'not {name}')) end"


def variant_faults(value: str, kind: DataType) -> Column:
    """path and fault of everything in the column `value` (variant) that the kind doesn't allow; absent values and nulls are allowed
    anywhere. One SQL text, as a schema of a hundred fields would take seconds to build call by call."""
    return F.expr(_faults(value, kind, "''", 0))


def document_faults(raw: DataFrame, schema: str, versions: tuple[str, ...]) -> DataFrame:
    """file, path and fault of documents (file, value): unreadable ones, other versions, unknown and mistyped fields at any depth.

    One pass over the documents; nothing is collected. A null or empty document is unreadable; path is null for whole documents.
    """
    version = F.try_variant_get("v", "$.schema_version", "string")
    row = lambda path, fault: F.array(F.struct(path.cast("string").alias("path"), fault.alias("fault")))
    told = (
        F.when(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), row(F.lit(None), F.lit("unreadable")))
        .when(~F.coalesce(version.isin(*versions), F.lit(False)), row(F.lit("schema_version"), F.concat(F.lit("version "), F.coalesce(version, F.lit("none")))))
        .otherwise(variant_faults("v", StructType.fromDDL(schema)))
    )
    found = raw.select("file", F.try_parse_json("value").alias("v")).select("file", F.inline(told))
    return found.select("file", F.regexp_replace("path", r"^\.", "").alias("path"), "fault")
