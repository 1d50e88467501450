"""Tests of JSON values by their native type, before anything is cast.

A reader with a declared schema casts, and what it casts depends on the columns that are asked for. Here a
document is one VARIANT and the test looks at the types its values were written with, so what is kept
doesn't change with what is selected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ANY = "variant"


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", f"map<string,{_ANY}>").isNotNull()


def field(value: Column, name: str) -> Column:
    """A member of an object as it was written; absent ones are null, and a written null is a value."""
    return F.try_variant_get(value, f"$.{name}", _ANY)


def has_native_type(value: Column, kind: T.DataType, nullable: bool = True) -> Column:
    """Whether ``value`` was written with this type, in all its members and elements.

    Integers are integers of 64 bits and neither true nor 1.0; numbers may be integers; ``nullable`` allows a
    written null. Absent values are not tested.
    """
    if isinstance(kind, T.StructType):
        fits = is_object(value)
        for member in kind.fields:
            fits = fits & has_native_type(field(value, member.name), member.dataType, member.nullable)
    elif isinstance(kind, T.ArrayType):
        elements = F.try_variant_get(value, "$", f"array<{_ANY}>")
        fits = elements.isNotNull() & F.coalesce(F.forall(elements, lambda x: has_native_type(x, kind.elementType, kind.containsNull)), F.lit(False))
    else:
        written = F.schema_of_variant(value)
        if isinstance(kind, T.LongType):
            fits = written == "BIGINT"
        elif isinstance(kind, T.DoubleType):
            fits = written.isin("BIGINT", "DOUBLE") | written.startswith("DECIMAL")
        elif isinstance(kind, T.StringType):
            fits = written == "STRING"
        elif isinstance(kind, T.BooleanType):
            fits = written == "BOOLEAN"
        else:
            raise ValueError(f"no native type for {kind.simpleString()}")
    if nullable:
        fits = fits | F.is_variant_null(value)
    return value.isNull() | F.coalesce(fits, F.lit(False))
