"""Between transport tables and general DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import dates
from tidewater.functions.text import hex_of_bytes
from tidewater.model import SchemaError
from tidewater.operators.tables import TransportTable
from tidewater.plans.planner import NUMERIC

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
AS_THEY_ARE = (T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BinaryType)


def to_frame(table: TransportTable) -> DataFrame:
    """The table's DataFrame, with bytes as lower-case hexadecimal text; other types are kept."""
    df = table.df
    return df.withColumns({f.name: hex_of_bytes(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.BinaryType)})


def from_frame(df: DataFrame, name: str) -> TransportTable:
    """A table of df: whole numbers widen to long, floats to double; dates and times stay what they are and are written as SAS numbers.

    Types without a counterpart (decimals, arrays, maps, structs, intervals) are errors: cast them first.
    """
    wide = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, WHOLE):
            wide[f.name] = c.cast("long")
        elif isinstance(f.dataType, T.FloatType):
            wide[f.name] = c.cast("double")
        elif not isinstance(f.dataType, AS_THEY_ARE):
            raise SchemaError(f"column {f.name}: {f.dataType.simpleString()} has no transport type")
    return TransportTable(df.withColumns(wide), name)


def sas_number(column: Column, kind: T.DataType) -> Column:
    """The double that a value of a numeric or temporal type is stored as."""
    if isinstance(kind, T.DateType):
        return dates.sas_days(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return dates.sas_seconds(column).cast("double")
    if isinstance(kind, NUMERIC):
        return column.cast("double")
    raise SchemaError(f"{kind.simpleString()} is not numeric")


def sas_numbers(df: DataFrame) -> DataFrame:
    """df with its numeric and temporal columns as stored."""
    return df.withColumns({f.name: sas_number(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if isinstance(f.dataType, NUMERIC)})
