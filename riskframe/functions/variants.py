"""Semi-structured values: JSON as VARIANT, read by declared fields, with the path of every fault.

A text is parsed once. Each field is read at its path with its type; a value of another kind isn't
bent into it but reported. Errors are ``path: reason`` in the order of the declaration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import limits as L
from riskframe.functions.text import let

#: Kinds of JSON values that a declared type may be read from, as Spark names them.
_KINDS = {
    "string": r"STRING", "bigint": r"BIGINT", "int": r"BIGINT", "double": r"BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)", "boolean": r"BOOLEAN", "object": r"OBJECT<.*>", "array": r"ARRAY<.*>",
}


@dataclass(frozen=True)
class Field:
    """A field of an object: its name, type, and what its value must be."""

    name: str
    kind: str = "string"
    required: bool = False
    allowed: Sequence[str] = ()
    low: float | None = None
    high: float | None = None


def parsed(text: Column) -> Column:
    """The value of a JSON text; NULL if it is none."""
    return F.try_parse_json(text)


def kind_of(value: Column) -> Column:
    """The kind of a VARIANT: STRING, BIGINT, OBJECT<...>, ARRAY<...>, VOID, ... NULL only if there is no value."""
    return F.schema_of_variant(value)


def is_kind(value: Column, kind: str) -> Column:
    return F.coalesce(kind_of(value).rlike(rf"\A(?:{_KINDS[kind]})\z"), F.lit(False))


def is_scalar(value: Column) -> Column:
    return ~F.coalesce(kind_of(value).rlike(r"\A(?:OBJECT|ARRAY)<"), F.lit(False))


def read(value: Column, field: Field) -> Column:
    """The field's value in its type, NULL if it is missing or of another kind."""
    inner = F.variant_get(value, f"$.{field.name}", "variant")
    return F.when(is_kind(inner, field.kind), F.try_variant_get(value, f"$.{field.name}", field.kind if field.kind not in ("object", "array") else "variant"))


def field_errors(value: Column, field: Field, path: Column) -> Column:
    """What is wrong with one field, or NULL."""
    at = F.concat(path, F.lit(field.name))
    inner = F.variant_get(value, f"$.{field.name}", "variant")
    missing = F.coalesce(kind_of(inner) == "VOID", F.lit(True))
    wrong = ~is_kind(inner, field.kind)
    out = F.when(missing, F.concat(at, F.lit(": missing")) if field.required else F.lit(None).cast("string")).when(wrong, F.concat(at, F.lit(": not "), F.lit(field.kind)))
    if field.allowed:
        out = out.when(~read(value, field).isin(*field.allowed), F.concat(at, F.lit(": not allowed")))
    if field.low is not None or field.high is not None:
        number = read(value, field).cast("double")
        outside = F.lit(False)
        if field.low is not None:
            outside = outside | (number < field.low)
        if field.high is not None:
            outside = outside | (number > field.high)
        out = out.when(outside, F.concat(at, F.lit(": out of range")))
    return out


def object_errors(value: Column, fields: Sequence[Field], path: Column | str = "") -> Column:
    """All faults of an object, in the order of the fields."""
    at = F.lit(path) if isinstance(path, str) else path
    whole = F.when(~is_kind(value, "object"), F.array(F.concat(F.nullif(F.rtrim(at, F.lit(".")), F.lit("")), F.lit(": not object"))))
    return F.coalesce(whole, F.array_compact(F.array(*[field_errors(value, f, at) for f in fields])))


def listed(value: Column, name: str) -> Column:
    """The elements of a list field as ARRAY<VARIANT>; empty if it is missing or no list."""
    inner = F.variant_get(value, f"$.{name}", "variant")
    return F.coalesce(F.when(is_kind(inner, "array"), F.try_variant_get(value, f"$.{name}", "array<variant>")), F.array().cast("array<variant>"))


def list_errors(value: Column, name: str, fields: Sequence[Field]) -> Column:
    """Faults of all objects of a list field, each under ``name[i].``; and of the list itself."""
    inner = F.variant_get(value, f"$.{name}", "variant")
    own = F.when(F.coalesce(kind_of(inner) == "VOID", F.lit(True)), F.array(F.lit(f"{name}: missing"))).when(~is_kind(inner, "array"), F.array(F.lit(f"{name}: not array")))
    each = F.flatten(F.transform(listed(value, name), lambda v, i: object_errors(v, fields, F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("].")))))
    return F.coalesce(own, each)


def typed(value: Column, fields: Sequence[Field]) -> Column:
    """The fields as a struct of typed values."""
    return F.struct(*[read(value, f).alias(f.name) for f in fields])


def metadata_errors(text: Column) -> Column:
    """Faults of a metadata object given as JSON text: it must be an object with a bounded number of plain keys, each with
    a scalar value, texts of a bounded length. A missing text has none."""
    def faults(value: Column) -> Column:
        entries = F.when(is_kind(value, "object"), value.cast("map<string,variant>"))
        keys, values = F.map_keys(entries), F.map_values(entries)
        long = lambda v: is_kind(v, "string") & (F.char_length(F.try_variant_get(v, "$", "string")) > L.MAX_META_VALUE_CHARS)
        checks = F.array(
            F.when(F.size(keys) > L.MAX_META_KEYS, "metadata: too many keys"),
            F.when(F.exists(keys, lambda k: ~k.rlike(rf"\A[A-Za-z0-9_-]{{1,{L.MAX_META_KEY_CHARS}}}\z")), "metadata: bad key"),
            F.when(F.exists(values, long), "metadata: value too long"),
            F.when(F.exists(values, lambda v: ~is_scalar(v)), "metadata: value is not a scalar"),
        )
        return F.when(value.isNull(), F.array(F.lit("metadata: not JSON"))).when(entries.isNull(), F.array(F.lit("metadata: not an object"))).otherwise(F.array_compact(checks))

    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(let(parsed(text), faults))


# --- model output ---------------------------------------------------------------------------------------

FINDING = (
    Field("risk_class", required=True), Field("rule_id"), Field("category", required=True, allowed=L.CATEGORIES), Field("likelihood", "int", True, low=1, high=5), Field("impact", "int", True, low=1, high=5),
    Field("description", required=True), Field("recommendation", required=True), Field("measure_codes", "array"), Field("confidence", "double", low=0, high=1), Field("evidence", required=True),
)
SCENE = (Field("location"), Field("location_type"), Field("time_of_day"), Field("characters", "array"), Field("action_text"), Field("dialogue", "array"))
LINE = (Field("character"), Field("parenthetical"), Field("text"))


def model_findings(output: Column) -> Column:
    """STRUCT<findings ARRAY<STRUCT>, errors ARRAY<STRING>> of a model's cleaned answer: the findings that have no fault, and all faults."""
    def split(value: Column) -> Column:
        good = F.filter(listed(value, "findings"), lambda v: F.size(object_errors(v, FINDING)) == 0)
        errors = F.when(value.isNull(), F.array(F.lit("not JSON"))).otherwise(list_errors(value, "findings", FINDING))
        return F.struct(F.transform(good, lambda v: typed(v, FINDING[:7])).alias("findings"), errors.alias("errors"))

    return let(parsed(output), split)
