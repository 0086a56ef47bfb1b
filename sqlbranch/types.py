"""Declared types, their affinity, and Spark's types."""

from __future__ import annotations

from pyspark.sql import types as T


def affinity(declared: str) -> str:
    """integer, text, blob, real or numeric, by what the declared type contains."""
    kind = declared.upper()
    if "INT" in kind:
        return "integer"
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT", "STRING")):
        return "text"
    if "BLOB" in kind or "BINARY" in kind or not kind:
        return "blob"
    if any(x in kind for x in ("REAL", "FLOA", "DOUB")):
        return "real"
    return "numeric"


def spark_type(declared: str) -> str:
    """The type that a column of the declared type is stored with."""
    kind = affinity(declared)
    if kind == "numeric":
        upper = declared.upper()
        if "VECTOR" in upper:
            return "array<float>"
        if "BOOL" in upper:
            return "boolean"
        if "TIMESTAMP" in upper or "DATETIME" in upper:
            return "timestamp_ntz"
        return "date" if "DATE" in upper else "double"
    return {"integer": "bigint", "text": "string", "blob": "binary" if declared else "string", "real": "double"}[kind]


def kind_of(dtype: T.DataType) -> str:
    """The name that typeof() gives a Spark type, or timestamp, vector and unknown."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dtype, T.ArrayType):
        return "vector"
    return {T.BooleanType: "boolean", T.BinaryType: "blob", T.NullType: "null"}.get(type(dtype), "unknown")
