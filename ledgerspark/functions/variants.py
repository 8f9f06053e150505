"""JSON values as VARIANT: members, each, keys taken away, concatenation, kinds, rows as values. No UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def value(text: Column) -> Column:
    """The value of a JSON text; text that is none gives null."""
    return F.try_parse_json(text)


def member(v: Column, path: str, kind: str = "string") -> Column:
    """A member by path; null where it is missing or of another kind."""
    return F.try_variant_get(v, path, kind)


def kind(v: Column) -> Column:
    """The kind of a value: null, boolean, number, string, array or object; a missing value has none."""
    said = F.schema_of_variant(v)
    return (
        F.when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array").when(said == "STRING", "string").when(said == "BOOLEAN", "boolean")
        .when(said == "VOID", "null").when(v.isNotNull(), "number")
    )


def members(v: Column) -> Column:
    """An object as a map from key to value; null for other kinds."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def minus(v: Column, *keys: str) -> Column:
    """An object without some keys."""
    return F.to_variant_object(F.map_filter(members(v), lambda k, _: ~k.isin(*keys)))


def concat(a: Column, b: Column) -> Column:
    """Two objects as one; where both have a key, the second's value stays."""
    left, right = members(a), members(b)
    return F.to_variant_object(F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right))


def of_row(*columns: str) -> Column:
    """The columns of a row as an object."""
    return F.to_variant_object(F.struct(*columns))


def text(v: Column) -> Column:
    """A value as JSON text; objects have their keys in order."""
    return F.to_json(v)


def each(d: DataFrame, column: str) -> DataFrame:
    """d with a row for each member of an object or element of an array: pos, key (none in arrays), value; other kinds give no row."""
    return d.lateralJoin(d.sparkSession.tvf.variant_explode(F.col(column).outer()))
