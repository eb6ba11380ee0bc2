"""Types of Python functions, built without a session so that workers can
import the modules that use them."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, IntegerType, StringType, StructType

TEXT, INT, DOUBLE, BYTES = StringType(), IntegerType(), DoubleType(), BinaryType()
TEXTS = ArrayType(TEXT)


def fields(**kinds: DataType) -> StructType:
    out = StructType()
    for name, kind in kinds.items():
        out.add(name, kind)
    return out


def rows(**kinds: DataType) -> ArrayType:
    return ArrayType(fields(**kinds))
