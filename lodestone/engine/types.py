"""DDL type names, in any case."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed names of the dialect.
NAMES = {
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(), "REAL": T.FloatType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "TEXT": T.StringType(), "VARCHAR": T.StringType(),
    "CHAR": T.StringType(), "STRING": T.StringType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "JSON": T.StringType(), "BLOB": T.BinaryType(),
}


def parse(name: str, arguments: list[int]) -> T.DataType:
    if name.upper() in ("DECIMAL", "NUMERIC"):
        return T.DecimalType(*(arguments or [18, 3]))
    try:
        return NAMES[name.upper()]
    except KeyError:
        raise ValueError(f"unknown type {name}") from None
