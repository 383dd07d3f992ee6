"""From a DataFrame and metadata to a byte layout. Data is read once at most: one aggregation for all text columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.text import cut_text
from tidewater.model import Format, FormatError, Plan, SchemaError, Variable, VariableMetadata

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
TEMPORAL_TEXT = {T.DateType: 10, T.TimestampType: 19, T.TimestampNTZType: 19}
KEYS = ("label", "format", "informat", "length", "role")


def describe(column: str, **about: object) -> dict:
    """Field metadata of a column: label, format, informat, length, role."""
    unknown = set(about) - set(KEYS)
    if unknown:
        raise SchemaError(f"{column}: no such metadata {sorted(unknown)}")
    return {f"transport.{k}": str(v) if k in ("format", "informat") else v for k, v in about.items() if v is not None}


def with_metadata(df: DataFrame, column: str, **about: object) -> DataFrame:
    """df with metadata on a column, added to what it has."""
    old = df.schema[column].metadata or {}
    return df.withMetadata(column, {**old, **describe(column, **about)})


def carry_metadata(source: DataFrame, df: DataFrame) -> DataFrame:
    """Give df's columns the metadata that source's of the same names have; expressions lose it."""
    known = {f.name: f.metadata for f in source.schema if f.metadata}
    for f in df.schema:
        if f.name in known and not f.metadata:
            df = df.withMetadata(f.name, known[f.name])
    return df


def _format(text: str | None) -> Format | None:
    return Format.parse(text) if text else None


def check_columns(df: DataFrame) -> None:
    if len(set(df.columns)) < len(df.columns):
        raise SchemaError("duplicate column names")
    for f in df.schema:
        if not isinstance(f.dataType, (*NUMERIC, T.StringType, T.BinaryType)):
            raise SchemaError(f"column {f.name}: {f.dataType.simpleString()} has no transport type; cast it first")


def plan_table(
    df: DataFrame,
    name: str,
    label: str | None = None,
    variables: list[VariableMetadata] | None = None,
    strict: bool = True,
    upper: bool = False,
    lengths: dict[str, int] | None = None,
) -> Plan:
    """The layout of df; ``lengths`` has the longest value of text columns where it is known already."""
    check_columns(df)
    about = {v.name: v for v in variables or []}
    drafts, measured = [], []
    for i, f in enumerate(df.schema):
        own, more = f.metadata or {}, about.get(f.name)
        numeric = isinstance(f.dataType, NUMERIC)
        if more and more.numeric is not None and more.numeric != numeric:
            if more.numeric or type(f.dataType) not in TEMPORAL_TEXT:
                raise SchemaError(f"column {f.name}: {f.dataType.simpleString()} can't be written as {'numeric' if more.numeric else 'character'}")
            numeric = False
        given = own.get("transport.length") or (more.length if more else None)
        v = Variable(f.name, numeric, 8 if numeric else given or 0, cut_text(own.get("transport.label") or "", 40), _format(own.get("transport.format")), _format(own.get("transport.informat")), own.get("transport.role"), source_index=i)
        if more:
            if more.label is not None:
                v = replace(v, label=cut_text(more.label, 40))
            if more.format is not None:
                try:
                    v = replace(v, format=Format.parse(more.format))
                except FormatError:
                    pass  # an external format that can't be parsed is left out
            if more.role is not None:
                v = replace(v, role=more.role)
        if not numeric:
            if type(f.dataType) in TEMPORAL_TEXT:
                v = replace(v, length=given or TEMPORAL_TEXT[type(f.dataType)])
            elif strict or not given:
                measured.append((f.name, given))
        drafts.append(v)
    if measured:
        known = dict(lengths or {})
        if rest := [c for c, _ in measured if c not in known]:
            known |= df.agg(*[F.coalesce(F.max(F.octet_length(F.col(f"`{c}`"))), F.lit(0)).alias(c) for c in rest]).first().asDict()
        for c, given in measured:
            if given and known[c] > given:
                raise SchemaError(f"character value exceeds specified length: max observed {known[c]} > specified {given}")
        drafts = [replace(v, length=v.length or max(1, known[v.name])) if v.name in known and not v.numeric else v for v in drafts]
    if any(m.order is not None for m in about.values() if m.name in df.columns):
        order = lambda v: about[v.name].order if v.name in about and about[v.name].order is not None else 2**31 - 1
        drafts.sort(key=order)
    plan = Plan(name, label, tuple(drafts))
    if upper:
        raised = lambda s: "".join(c.upper() if c.isascii() else c for c in s)
        plan = replace(plan, name=raised(name), variables=tuple(replace(v, name=raised(v.name)) for v in plan.variables))
    return plan.laid_out()


def plan_frame(spark, plan: Plan) -> DataFrame:
    """The plan as a table, a row for each variable."""
    rows = [(i + 1, v.name, "Num" if v.numeric else "Char", v.length, v.position, v.label, str(v.format) if v.format else None, str(v.informat) if v.informat else None, v.role) for i, v in enumerate(plan.variables)]
    return spark.createDataFrame(rows, "varnum int, name string, type string, length int, position int, label string, format string, informat string, role string")
