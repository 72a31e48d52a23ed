"""Type guards over VARIANT columns (parsed JSON values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_null_or_undefined(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _is(value: Column, test: Column) -> Column:
    return F.coalesce(~is_null_or_undefined(value) & test, F.lit(False))


def is_object(value: Column) -> Column:
    return _is(value, _kind(value).startswith("OBJECT"))


def is_string(value: Column) -> Column:
    return _is(value, _kind(value) == "STRING")


def is_number(value: Column) -> Column:
    return _is(value, _kind(value).isin("BIGINT", "DOUBLE", "FLOAT") | _kind(value).startswith("DECIMAL"))


def is_boolean(value: Column) -> Column:
    return _is(value, _kind(value) == "BOOLEAN")


def is_array(value: Column) -> Column:
    return _is(value, _kind(value).startswith("ARRAY"))


def is_primitive(value: Column) -> Column:
    return ~(is_object(value) | is_array(value))
