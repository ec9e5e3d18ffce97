"""The language's types, their defaults, and intervals."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names and the Spark types that hold them. Unsigned types have no like in Spark and widen.
NAMES: dict[str, T.DataType] = {
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "INT64": T.LongType(), "BIGINT": T.LongType(), "SERIAL": T.LongType(),
    "UINT8": T.ShortType(), "UINT16": T.IntegerType(), "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0), "INT128": T.DecimalType(38, 0),
    "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(), "UUID": T.StringType(),
    "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "DATETIME": T.TimestampNTZType(),
}
INTERVAL = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])
DAY = 86_400_000_000


def is_interval(kind: T.DataType | None) -> bool:
    """Whether a column's type is that of intervals, nullable or not."""
    return isinstance(kind, T.StructType) and kind.names == INTERVAL.names


def spark_type(name: str) -> T.DataType:
    """The Spark type of a type's name, such as INT64, VARCHAR(20), DECIMAL(5, 2) or INT64[]."""
    name = name.strip().upper()
    if name.endswith("[]"):
        return T.ArrayType(spark_type(name[:-2]))
    base, _, rest = name.partition("(")
    if base == "DECIMAL" and rest:
        p, s = (int(x) for x in rest.rstrip(")").split(","))
        return T.DecimalType(p, s)
    if base in ("INTERVAL", "DURATION"):
        return INTERVAL
    if base not in NAMES:
        raise ValueError(f"unknown type {name}")
    return NAMES[base]


def default_of(kind: T.DataType) -> Any:
    """What stands for a missing value of the type in a loaded table."""
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)):
        return 0
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return 0.0
    if isinstance(kind, T.BooleanType):
        return False
    if isinstance(kind, T.StringType):
        return ""
    return None


def default_column(kind: T.DataType) -> Column:
    value = default_of(kind)
    if value is not None:
        return F.lit(value).cast(kind)
    if isinstance(kind, T.DateType):
        return F.lit("1970-01-01").cast(kind)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit("1970-01-01 00:00:00").cast(kind)
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class Interval:
    months: int = 0
    days: int = 0
    micros: int = 0

    def column(self) -> Column:
        return interval(F.lit(self.months), F.lit(self.days), F.lit(self.micros))


_UNIT = {"year": ("months", 12), "month": ("months", 1), "day": ("days", 1), "hour": ("micros", 3_600_000_000), "minute": ("micros", 60_000_000), "second": ("micros", 1_000_000), "millisecond": ("micros", 1_000), "microsecond": ("micros", 1), "us": ("micros", 1)}


def parse_interval(text: str) -> Interval:
    """An interval such as `1 year 2 months 3days 4 hours`."""
    low, at, out = text.strip().lower(), 0, {"months": 0, "days": 0, "micros": 0}
    while at < len(low):
        m = re.compile(r"\s*(\d+)\s*([a-z]+)").match(low, at)
        unit = m and (m[2] if m[2] in _UNIT else m[2].removesuffix("s"))
        if not m or unit not in _UNIT:
            raise ValueError(f"no interval: {text!r}")
        part, size = _UNIT[unit]
        out[part] += int(m[1]) * size
        at = m.end()
    if not low:
        raise ValueError("an empty interval")
    return Interval(**out)


def interval(months: Column, days: Column, micros: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("long").alias("micros"))


def normal(i: Column) -> Column:
    """An interval with what is over a day or 30 days carried on, so that equal lengths are equal and order is by length."""
    days = i["days"] + F.floor(i["micros"] / F.lit(DAY))
    return F.when(i.isNotNull(), interval(i["months"] + F.floor(days / F.lit(30)), F.pmod(days, F.lit(30)), F.pmod(i["micros"], F.lit(DAY))))


def negate(i: Column) -> Column:
    return F.when(i.isNotNull(), interval(-i["months"], -i["days"], -i["micros"]))


def add_intervals(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), interval(a["months"] + b["months"], a["days"] + b["days"], a["micros"] + b["micros"]))


def date_plus(d: Column, i: Column) -> Column:
    """Months first (a day beyond the month's end is its last), then days and whole days of the rest."""
    return F.date_add(F.add_months(d, i["months"]), (i["days"] + F.floor(i["micros"] / F.lit(DAY))).cast("int"))


def timestamp_plus(t: Column, i: Column) -> Column:
    """Months on the date, then days, then milliseconds."""
    date = F.to_date(t)
    moved = F.date_add(F.add_months(date, i["months"]), i["days"])
    within = micros_of(t) - micros_of(date.cast("timestamp_ntz"))
    total = micros_of(moved.cast("timestamp_ntz")) + within + F.floor(i["micros"] / F.lit(1000)) * F.lit(1000)
    return F.timestamp_micros(total).cast("timestamp_ntz")


def micros_of(t: Column) -> Column:
    """Microseconds since 1970, in UTC."""
    return F.unix_micros(t.cast("timestamp"))


def difference(a: Column, b: Column) -> Column:
    """a - b of two dates or timestamps, in milliseconds' precision."""
    return F.when(a.isNotNull() & b.isNotNull(), interval(F.lit(0), F.lit(0), F.floor((micros_of(a.cast("timestamp_ntz")) - micros_of(b.cast("timestamp_ntz"))) / F.lit(1000)) * F.lit(1000)))


def milliseconds(i: Column) -> Column:
    """Days and the rest; months don't count."""
    return i["days"].cast("long") * F.lit(86_400_000) + F.floor(i["micros"] / F.lit(1000))
