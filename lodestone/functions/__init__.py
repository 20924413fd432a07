"""Expression helpers where SQL dialects differ; all are built-in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ieee_div(a: Column, b: Column) -> Column:
    """Division in doubles with inf and nan instead of an error on zero; null if either side is null."""
    x, y = a.cast("double"), b.cast("double")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    minus = F.startswith(y.cast("string"), F.lit("-"))  # tells -0.0 from 0.0
    at_zero = F.when(x.isNull(), None).when((x == 0) | F.isnan(x), nan).when((x > 0) != minus, inf).otherwise(-inf)
    return F.when(y.isNull() | x.isNull(), F.lit(None).cast("double")).when(y != 0, x / F.when(y != 0, y)).otherwise(at_zero)


def djb2(key: Column) -> Column:
    """The 32-bit hash h = 33 h + byte, from 5381, over the UTF-8 bytes of the key's text."""
    digits = F.hex(F.encode(key.cast("string"), "UTF-8"))
    n = (F.length(digits) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    digit = lambda i: F.instr(F.lit("123456789ABCDEF"), F.substring(digits, i, F.lit(1)))  # noqa: E731  0 where it is a zero
    step = lambda h, i: (h * 33 + digit(2 * i + 1) * 16 + digit(2 * i + 2)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(key.isNotNull(), F.aggregate(at, F.lit(5381).cast("long"), step))


def djb2_of(key: object) -> int:
    """The same hash of a constant."""
    h = 5381
    for byte in str(key).encode():
        h = (h * 33 + byte) & 0xFFFFFFFF
    return h


def shard_of(key: Column, shards: int) -> Column:
    return (djb2(key) % shards).cast("int")


def lenient(df: DataFrame, schema: StructType) -> DataFrame:
    """Text columns read as the schema's types; what can't be read is null instead of an error."""
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def general(c: Column, digits: int = 10) -> Column:
    """A double with so many significant digits: plain where its exponent is from -4 up to ``digits`` - 1, else with an exponent."""
    x = c.cast("double")
    exact = F.format_string(f"%.{digits - 1}e", x)  # -d.ddde+xx
    sign = F.when(F.startswith(exact, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_replace(F.substring_index(exact, "e", 1), r"[-.]", "")
    power = F.substring_index(exact, "e", -1)
    e = power.cast("int")
    below = F.concat(F.substring(F.lit("000"), F.lit(1), -e - 1), mantissa)
    whole = F.when(e < 0, F.lit("0")).otherwise(F.substring(mantissa, F.lit(1), e + 1))
    plain = F.concat(whole, F.lit("."), F.when(e < 0, below).otherwise(F.substring(mantissa, e + 2, F.lit(digits))))
    scaled = F.concat(F.substring(mantissa, 1, 1), F.lit("."), F.substring(mantissa, 2, digits))
    bare = lambda t: F.regexp_replace(t, r"\.?0*$", "")  # noqa: E731  all texts here have a point
    text = F.when((e < -4) | (e >= digits), F.concat(sign, bare(scaled), F.lit("e"), power)).otherwise(F.concat(sign, bare(plain)))
    infinite = F.abs(x) == F.lit(float("inf"))
    return F.when(x.isNull(), None).when(F.isnan(x), "nan").when(infinite, F.when(x > 0, "inf").otherwise("-inf")).otherwise(text)


def fmt_value(c: Column, kind: str) -> Column:
    """Text as a wire client sees it: null as NULL, booleans upper-case, doubles with ten significant digits."""
    if kind == "boolean":
        text = F.upper(c.cast("string"))
    elif kind in ("double", "float"):
        text = general(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NULL"))
