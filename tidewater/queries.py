"""Registered queries of the transport engine, with DuckDB SQL that computes the same from the Parquet tables."""

from __future__ import annotations

import datetime as dt
import os
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import dates, ibm, text
from tidewater.model import Format, FormatError, VariableMetadata
from tidewater.operators import bridge, tables
from tidewater.operators.scratch import scratch
from tidewater.plans import planner, rules, sizes
from tidewater.sources import sample_standard, standards
from tidewater.streaming import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WHEN = dt.datetime(2024, 6, 15, 14, 30, 45)
#: Names of at most 8 bytes for tables that are written.
NAMES = {
    "lineitem": {"l_orderkey": "ORDKEY", "l_partkey": "PARTKEY", "l_suppkey": "SUPPKEY", "l_linenumber": "LINENO", "l_quantity": "QTY", "l_extendedprice": "EXTPRICE", "l_discount": "DISCOUNT", "l_tax": "TAX", "l_returnflag": "RETFLAG", "l_linestatus": "LINESTAT", "l_shipdate": "SHIPDT"},
    "customer": {"c_custkey": "CUSTKEY", "c_name": "NAME", "c_nationkey": "NATKEY", "c_acctbal": "ACCTBAL", "c_mktsegment": "SEGMENT"},
    "nation": {"n_nationkey": "NKEY", "n_name": "NNAME", "n_regionkey": "RKEY"},
    "supplier": {"s_suppkey": "SUPPKEY", "s_name": "NAME", "s_nationkey": "NATKEY", "s_acctbal": "ACCTBAL"},
}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return source(spark, sf_dir, name).withColumnsRenamed(NAMES[name])


def written(spark: SparkSession, df: DataFrame, name: str, **options) -> str:
    """A transport file of df."""
    path = f"{scratch(spark, name)}/{name.lower()}.xpt"
    tables.writer(tables.TransportTable(df, name[:8].upper(), f"Table {name}"), created=WHEN, **options).finalize().write_path(path)
    return path


def back(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    return tables.read(spark, written(spark, short(spark, sf_dir, name), name), **options).df


@query("""select l_orderkey::double as ORDKEY, l_partkey::double as PARTKEY, l_suppkey::double as SUPPKEY, l_linenumber::double as LINENO, l_quantity as QTY, l_extendedprice as EXTPRICE,
l_discount as DISCOUNT, l_tax as TAX, nullif(rtrim(l_returnflag), '') as RETFLAG, nullif(rtrim(l_linestatus), '') as LINESTAT, date_diff('second', timestamp '1960-01-01', l_shipdate)::double as SHIPDT from lineitem""")
def xpt_roundtrip_lineitem(spark, sf_dir):
    return back(spark, sf_dir, "lineitem")


@query("""select c_custkey::double as CUSTKEY, nullif(rtrim(c_name), '') as NAME, c_nationkey::double as NATKEY, c_acctbal as ACCTBAL, nullif(rtrim(c_mktsegment), '') as SEGMENT from customer""")
def xpt_roundtrip_text(spark, sf_dir):
    return back(spark, sf_dir, "customer")


@query("""select l_returnflag as RETFLAG, l_linestatus as LINESTAT, count(*) as n_rows, sum(l_quantity) as sum_qty, max(l_extendedprice) as max_price, min(l_discount) as min_discount from lineitem group by 1, 2""")
def xpt_aggregate_lineitem(spark, sf_dir):
    df = back(spark, sf_dir, "lineitem", columns="RETFLAG,LINESTAT,QTY,EXTPRICE,DISCOUNT")
    return df.groupBy("RETFLAG", "LINESTAT").agg(F.count("*").alias("n_rows"), F.sum("QTY").alias("sum_qty"), F.max("EXTPRICE").alias("max_price"), F.min("DISCOUNT").alias("min_discount"))


ENCODE_SQL = """case when x is null then '2E00000000000000' when x = 0 then '0000000000000000' else
 (select format('{:02X}{:014X}', (k + 64 + case when x < 0 then 128 else 0 end)::bigint, (greatest(abs(x), 1e-300) * pow(16, 14 - greatest(k, -60)))::bigint) from
  (select case when abs(x) >= pow(16, g) then g + 1 when abs(x) < pow(16, g - 1) then g - 1 else g end as k from (select (floor(log2(greatest(abs(x), 1e-300)) / 4) + 1)::int as g))) end"""


@query(f"""with v as (select l_orderkey as id, l_linenumber as line, unnest([l_extendedprice, -l_quantity, l_discount, l_tax, 1e10 * l_discount, l_tax / 7]) as x from lineitem)
select id, line, x, {ENCODE_SQL} as encoded from v""")
def ibm_encode_hex(spark, sf_dir):
    x = F.explode(F.array("l_extendedprice", -F.col("l_quantity"), "l_discount", "l_tax", 1e10 * F.col("l_discount"), F.col("l_tax") / 7))
    rows = source(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), x.alias("x"))
    return rows.withColumn("encoded", F.hex(ibm.ibm_encode(F.col("x"))))


@query("select o_orderkey as id, o_totalprice as x, -o_totalprice / 3 as y from orders")
def ibm_decode_values(spark, sf_dir):
    turn = lambda c: ibm.ibm_decode(ibm.ibm_encode(c))
    return source(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), turn(F.col("o_totalprice")).alias("x"), turn(-F.col("o_totalprice") / 3).alias("y"))


@query("""with k as (select '.' as kind, '2E' as lead union all select '._', '5F' union all select '.' || chr(c::int), format('{:02X}', c) from range(65, 91) t(c))
select kind, lead || '00000000000000' as raw, kind as found, null::double as value from k""")
def missing_codes(spark, sf_dir):
    kinds = spark.createDataFrame([(".",), ("._",), *((f".{chr(c)}",) for c in range(65, 91))], "kind string")
    rows = kinds.withColumn("bytes", ibm.encode_missing(F.col("kind")))
    return rows.select("kind", F.hex("bytes").alias("raw"), ibm.missing_kind(F.col("bytes")).alias("found"), ibm.ibm_decode(F.col("bytes")).alias("value"))


@query("""select o_orderkey as id, date_diff('day', date '1960-01-01', o_orderdate::date)::bigint as days, date_diff('second', timestamp '1960-01-01', o_orderdate)::bigint as seconds,
strftime(o_orderdate, '%Y-%m-%d') as day_back, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as stamp_back from orders""")
def sas_date_parts(spark, sf_dir):
    day, stamp = F.col("o_orderdate").cast("date"), F.col("o_orderdate")
    rows = source(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.sas_days(day).cast("long").alias("days"), dates.sas_seconds(stamp).cast("long").alias("seconds"))
    return rows.withColumns({"day_back": dates.iso_date(dates.date_of_sas(F.col("days"))), "stamp_back": dates.iso_stamp(dates.stamp_of_sas(F.col("seconds")))})


@query("""select event_id as id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::bigint as seconds, strftime(ts, '%H:%M:%S') as time_back, date_diff('second', timestamp '1960-01-01', date_trunc('second', ts))::bigint as stamp from events""")
def sas_time_roundtrip(spark, sf_dir):
    s = dates.seconds_of_day(F.col("ts")).cast("long")
    return source(spark, sf_dir, "events").select(F.col("event_id").alias("id"), s.alias("seconds"), dates.time_of_sas(s).alias("time_back"), dates.sas_seconds(F.col("ts")).cast("long").alias("stamp"))


def _plan_sql(table: str, columns: dict[str, bool]) -> str:
    """columns: name -> numeric."""
    lengths = " union all ".join(f"select {i + 1} as varnum, '{c}' as name, '{'Num' if n else 'Char'}' as type, " + ("8" if n else f"(select greatest(1, coalesce(max(strlen({c})), 0)) from {table})") + "::int as length" for i, (c, n) in enumerate(columns.items()))
    return f"with v as ({lengths}) select varnum, name, type, length, coalesce(sum(length) over (order by varnum rows between unbounded preceding and 1 preceding), 0)::int as position from v"


PLANNED = {
    "customer": {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False},
    "part": {"p_partkey": True, "p_name": False, "p_brand": False, "p_type": False, "p_size": True, "p_retailprice": True},
    "documents": {"doc_id": True, "text": False, "lang": False, "source": False, "n_chars": True},
    "conversations": {"conv_id": True, "turn": True, "role": False, "text": False},
    "events": {"event_id": True, "ts": True, "user_id": True, "event_type": False, "value": True, "props": False},
}


def _plan_query(table: str):
    def planned(spark, sf_dir):
        plan = planner.plan_table(source(spark, sf_dir, table), table)
        return planner.plan_frame(spark, plan).select("varnum", "name", "type", "length", "position")

    planned.__name__ = f"schema_plan_{table}"
    return query(_plan_sql(table, PLANNED[table]))(planned)


for _t in PLANNED:
    _plan_query(_t)


@query("""with v(varnum, name, length, label, format, role) as (values (1, 'c_name', (select max(strlen(c_name)) from customer)::int, 'Customer', null, null), (2, 'c_custkey', 8, 'Key from outside', 'F8.2', 'Identifier'),
(3, 'c_nationkey', 8, '', null, null), (4, 'c_acctbal', 8, '', null, null), (5, 'c_mktsegment', 40, repeat('é', 20), null, null))
select varnum, name, length, coalesce(sum(length) over (order by varnum rows between unbounded preceding and 1 preceding), 0)::int as position, label, format, role from v""")
def plan_override_order(spark, sf_dir):
    df = planner.with_metadata(source(spark, sf_dir, "customer"), "c_custkey", label="Own label", format="DATE9.")
    df = planner.with_metadata(df, "c_name", label="Customer")
    about = [VariableMetadata("c_custkey", label="Key from outside", format="f8.2", role="Identifier", order=2), VariableMetadata("c_name", order=1, format="broken"), VariableMetadata("c_mktsegment", length=40, label="é" * 30)]
    return planner.plan_frame(spark, planner.plan_table(df, "CUST", variables=about)).select("varnum", "name", "length", "position", "label", "format", "role")


# (name, numeric, length, label) of a plan that breaks many rules
BROKEN = [("AESEQ", True, 8, "Sequence"), ("lowercase1", True, 8, ""), ("ÉTAT", False, 250, "Températures relevées cet été passé"), ("_OK1", False, 200, "x" * 40), ("9BAD", False, 1, "ok"), ("TOOLONGNAME", True, 8, "木火土金水日月木火土金水日")]


def _broken():
    from tidewater.model import Plan, Variable

    return Plan("aeé", "木火土金" * 4, tuple(Variable(n, num, size, label) for n, num, size, label in BROKEN)).laid_out()


def _issues_sql(agency: str | None) -> str:
    rows = ", ".join(f"({i + 1}, 'variable', '{n}', {str(num).lower()}, {size}, '{label}')" for i, (n, num, size, label) in enumerate(BROKEN))
    base = f"with p(i, kind, name, num, len, label) as (values (0, 'dataset', 'aeé', null, null, '{'木火土金' * 4}'), {rows}), w as (select *, upper(kind[1]) || kind[2:] as word, strlen(name) as nb, strlen(label) as lb from p)"
    parts = [
        "select word || 'NameTooLong' as code, 'ERROR' as severity, kind, name from w where nb > 8",
        "select 'Missing' || word || 'Label', 'WARN', kind, name from w where label = '' and kind = 'variable'",
        "select word || 'LabelTooLong', 'ERROR', kind, name from w where lb > 40",
        "select 'CharacterLengthTooLong', 'ERROR', kind, name from w where not num and len > 200",
    ]
    if agency:
        ascii_test = r"regexp_matches({}, '[^\x00-\x7F]')"
        parts += [
            f"select 'NonAscii' || word || 'Name', 'ERROR', kind, name from w where {ascii_test.format('name')}",
            "select 'Agency' || word || 'NameTooLong', 'ERROR', kind, name from w where nb > 8",
            "select 'AgencyLabelTooLong', 'ERROR', kind, name from w where lb > 40",
            f"select 'MultiByteLabelNearLimit', 'WARN', kind, name from w where lb between 32 and 40 and {ascii_test.format('label')}",
            "select 'CharacterValueLengthExceeded', 'WARN', kind, name from w where not num and len > 200",
            "select word || 'NamePatternMismatch', 'ERROR', kind, name from w where not regexp_full_match(name, case when kind = 'dataset' then '[A-Z][A-Z0-9]{0,7}' else '[A-Z_][A-Z0-9_]{0,7}' end)",
        ]
        if agency == "FDA":
            parts.append(f"select 'NonAscii' || word || 'Label', 'ERROR', kind, name from w where {ascii_test.format('label')}")
    return f"{base} select code, severity, kind as target_kind, name as target from ({' union all '.join(parts)})"


def _issue_query(name: str, agency: rules.Agency | None):
    def found(spark, sf_dir):
        return rules.issue_frame(spark, rules.validate(_broken(), agency)).select("code", "severity", "target_kind", "target")

    found.__name__ = name
    return query(_issues_sql(agency.name if agency else None))(found)


_issue_query("issues_structural", None)
for _a in rules.AGENCIES.values():
    _issue_query(f"issues_{_a.name.lower()}", _a)


@query("""select 'text' as name, count(*) filter (regexp_matches(text, '[^\\x00-\\x7F]')) as n, coalesce(max(strlen(text)), 0)::int as longest from documents
union all select 'lang', count(*) filter (regexp_matches(lang, '[^\\x00-\\x7F]')), coalesce(max(strlen(lang)), 0)::int from documents
union all select 'source', count(*) filter (regexp_matches(source, '[^\\x00-\\x7F]')), coalesce(max(strlen(source)), 0)::int from documents""")
def value_ascii_scan(spark, sf_dir):
    return rules.non_ascii_values(source(spark, sf_dir, "documents"))


@query("""select doc_id, left(text, (select coalesce(max(i), 0) from range(0, 41) t(i) where i <= length(text) and strlen(left(text, i)) <= 40)::int) as cut from documents where text is not null
union all select doc_id, null from documents where text is null""")
def utf8_truncate_40(spark, sf_dir):
    return source(spark, sf_dir, "documents").select("doc_id", text.truncate_text(F.col("text"), 40).alias("cut"))


@query("""select doc_id, lower(hex(encode(left(text, 12)))) as hexed, regexp_full_match(text, '[\\x20-\\x7E]*') as printable from documents""")
def text_bytes(spark, sf_dir):
    rows = source(spark, sf_dir, "documents")
    return rows.select("doc_id", text.hex_of_bytes(F.encode(F.left("text", F.lit(12)), "UTF-8")).alias("hexed"), text.is_printable(F.col("text")).alias("printable"))


@query("select n_name as name, upper(hex(encode(rpad(left(n_name, 6), 6, ' ')))) as fixed from nation")
def text_padding(spark, sf_dir):
    return source(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.hex(text.pad_text(F.col("n_name"), 6)).alias("fixed"))


@query("""with t as (select (select count(*) from lineitem) as n, 11 as nvars, 9 * 8 + (select max(strlen(l_returnflag)) from lineitem) + (select max(strlen(l_linestatus)) from lineitem) as row_bytes)
select n::bigint as n_rows, row_bytes::bigint as row_bytes, (9 * 80 + ceil(nvars * 140 / 80.0) * 80 + ceil(n * row_bytes / 80.0) * 80)::bigint as file_bytes, (8 * 80 + ceil(nvars * 140 / 80.0) * 80 + ceil(n * row_bytes / 80.0) * 80)::bigint as estimate,
floor(floor((1000000 - 9 * 80 - ceil(nvars * 140 / 80.0) * 80) / 80) * 80 / row_bytes)::bigint as rows_fit, floor((1000000 - 8 * 80 - ceil(nvars * 140 / 80.0) * 80) / row_bytes)::bigint as rows_fit_estimate from t""")
def size_estimate(spark, sf_dir):
    df = short(spark, sf_dir, "lineitem")
    plan, n = planner.plan_table(df, "LINEITEM"), df.count()
    row = (n, plan.row_bytes, sizes.file_size(plan, n), sizes.file_size(plan, n, True), sizes.rows_that_fit(plan, 1_000_000), sizes.rows_that_fit(plan, 1_000_000, True))
    return spark.createDataFrame([row], "n_rows long, row_bytes long, file_bytes long, estimate long, rows_fit long, rows_fit_estimate long")


def _split_files(spark, sf_dir) -> list[str]:
    df = short(spark, sf_dir, "customer")
    plan = tables.writer(tables.TransportTable(df, "CUSTOMER", "Customers"), created=WHEN, order_by=["CUSTKEY"]).max_file_size_gb(16_384 / sizes.GIB)
    return plan.finalize().write_path(f"{scratch(spark, 'split')}/customer.xpt")


@query("""select c_custkey::double as CUSTKEY, nullif(rtrim(c_name), '') as NAME, c_nationkey::double as NATKEY, c_acctbal as ACCTBAL, nullif(rtrim(c_mktsegment), '') as SEGMENT from customer""")
def split_roundtrip(spark, sf_dir):
    return tables.read(spark, _split_files(spark, sf_dir)).df


@query("""with t as (select count(*) as n, 24 + max(strlen(c_name)) + max(strlen(c_mktsegment)) as row_bytes from customer), m as (select n, row_bytes, floor(floor((16384 - 720 - 720) / 80) * 80 / row_bytes)::bigint as most from t)
select case when n <= most then 'customer.xpt' else format('customer_{:03}.xpt', i + 1) end as file, least(most, n - i * most)::bigint as n_rows, (720 + 720 + ceil(least(most, n - i * most) * row_bytes / 80.0) * 80)::bigint as bytes from m, range(0, 100000) r(i) where i * most < n""")
def split_plan(spark, sf_dir):
    rows = [(os.path.basename(p), tables.inspect(p).members[0].rows, os.path.getsize(p)) for p in _split_files(spark, sf_dir)]
    return spark.createDataFrame(rows, "file string, n_rows long, bytes long")


@query("select c_custkey::double as CUSTKEY, nullif(rtrim(c_name), '') as NAME from customer order by c_custkey limit 37")
def row_limit(spark, sf_dir):
    df = short(spark, sf_dir, "customer").select("CUSTKEY", "NAME")
    return tables.read(spark, written(spark, df, "cust", order_by=["CUSTKEY"]), rowLimit=37).df


@query("select s_suppkey::double as SUPPKEY, nullif(rtrim(s_name), '') as NAME, (row_number() over (order by s_suppkey) - 1)::bigint as _row_id from supplier qualify _row_id >= 10 and _row_id < 25")
def row_slice(spark, sf_dir):
    df = short(spark, sf_dir, "supplier").select("SUPPKEY", "NAME")
    return tables.read(spark, written(spark, df, "supp", order_by=["SUPPKEY"]), rowId=True).rows(10, 25).df


def _two_members(spark, sf_dir) -> str:
    """A library of two tables: the second file's member records after the first file."""
    one, two = (written(spark, short(spark, sf_dir, t), t) for t in ("nation", "supplier"))
    path = f"{scratch(spark, 'library')}/both.xpt"
    with open(path, "wb") as out:
        with open(one, "rb") as f:
            out.write(f.read())
        with open(two, "rb") as f:
            out.write(f.read()[3 * 80 :])
    return path


MEMBERS_SQL = """select 'NATION' as name, 'Table nation' as label, 3 as n_variables, (16 + max(strlen(n_name)))::int as row_bytes, count(*) as n_rows from nation
union all select 'SUPPLIER', 'Table supplier', 4, (24 + max(strlen(s_name)))::int, count(*) from supplier"""


@query(MEMBERS_SQL)
def inspect_members(spark, sf_dir):
    return tables.member_frame(spark, tables.inspect(_two_members(spark, sf_dir))).drop("first_byte")


@query("""select * from (values (1, 'SUPPKEY', 'Num', 8, 0), (2, 'NAME', 'Char', (select max(strlen(s_name)) from supplier)::int, 8), (3, 'NATKEY', 'Num', 8, 8 + (select max(strlen(s_name)) from supplier)::int),
(4, 'ACCTBAL', 'Num', 8, 16 + (select max(strlen(s_name)) from supplier)::int)) v(varnum, name, type, length, position)""")
def inspect_variables(spark, sf_dir):
    plan = tables.inspect(_two_members(spark, sf_dir)).find("supplier").plan
    return planner.plan_frame(spark, plan).select("varnum", "name", "type", "length", "position")


@query("select s_suppkey::double as SUPPKEY, nullif(rtrim(s_name), '') as NAME, s_nationkey::double as NATKEY, s_acctbal as ACCTBAL from supplier")
def read_second_member(spark, sf_dir):
    return tables.read(spark, _two_members(spark, sf_dir), member="Supplier").df


@query("select 'NATION' as name, count(*) as n_rows from nation union all select 'SUPPLIER', count(*) from supplier")
def read_all_members(spark, sf_dir):
    found = [t.df.agg(F.lit(t.name).alias("name"), F.count("*").alias("n_rows")) for t in tables.read_all(spark, _two_members(spark, sf_dir))]
    return found[0].union(found[1])


@query("""select * from (values ('NKEY', 'Nation Key', 'BEST12.', null, 0), ('NNAME', 'Name of the Nation', 'CHAR20.', 'CHAR20.', 25), ('RKEY', null, null, null, 0)) v(name, label, format, informat, length)""")
def metadata_roundtrip(spark, sf_dir):
    df = short(spark, sf_dir, "nation")
    df = planner.with_metadata(df, "NKEY", label="Nation Key", format=Format.parse("BEST12."), role="Identifier")
    df = planner.with_metadata(df, "NNAME", label="Name of the Nation", format=Format.character(20), informat="$CHAR20.", length=25)
    df = planner.with_metadata(df, "RKEY", format="8.2")
    found = tables.read(spark, written(spark, df, "nation"))
    rows = [(f.name, *(f.metadata.get(f"transport.{k}") for k in ("label", "format", "informat")), f.metadata.get("transport.length", 0)) for f in found]
    return spark.createDataFrame(rows, "name string, label string, format string, informat string, length int")


FORMATS = ["DATE9.", "8.2", "8.", "BEST12.", "$CHAR200.", "date9.", " $10. ", "E8601DT19.3", "", "DATE", ".2", "DATE.", "8.x", "$.", "99999.", "A.B8.1"]


@query(f"""with t as (select unnest({FORMATS}) as input), m as (select input, trim(input) as s, regexp_full_match(trim(input), '\\$?.*[0-9]+\\.[0-9]*') as shaped from t),
p as (select *, regexp_extract(s, '^(\\$?)(.*?)([0-9]+)\\.([0-9]*)$', ['dollar', 'nm', 'w', 'd']) as g from m)
select input, coalesce(shaped and try_cast(g.w as int) <= 65535, false) as valid, case when valid then g.dollar || upper(g.nm) end as name, case when valid then try_cast(g.w as int) else -1 end as width, case when valid then coalesce(try_cast(g.d as int), 0) else -1 end as decimals,
case when valid then g.dollar || upper(g.nm) || try_cast(g.w as int)::varchar || '.' || case when coalesce(try_cast(g.d as int), 0) > 0 then try_cast(g.d as int)::varchar else '' end end as shown from p""")
def format_parse(spark, sf_dir):
    rows = []
    for s in FORMATS:
        try:
            f = Format.parse(s)
            rows.append((s, True, f.name, f.width, f.decimals, str(f)))
        except FormatError:
            rows.append((s, False, None, -1, -1, None))
    return spark.createDataFrame(rows, "input string, valid boolean, name string, width int, decimals int, shown string")


@query("select n_nationkey::double as NKEY, nullif(rtrim(n_name), '') as NNAME, n_regionkey::double as RKEY from nation union all select r_regionkey::double, nullif(rtrim(r_name), ''), r_regionkey::double from region")
def append_tables(spark, sf_dir):
    region = source(spark, sf_dir, "region").select(F.col("r_regionkey").alias("K"), F.col("r_name").alias("N"), F.col("r_regionkey").alias("R"))
    one, two = (tables.read(spark, written(spark, df, name)) for df, name in ((short(spark, sf_dir, "nation"), "nation"), (region, "region")))
    return one.append(two).df


@query("select n_nationkey::double as NKEY, upper(n_name) as LOUD, n_nationkey::double * 2 as TWICE from nation where n_regionkey >= 2")
def derive_and_filter(spark, sf_dir):
    t = tables.read(spark, written(spark, short(spark, sf_dir, "nation"), "nation"))
    return t.extend(LOUD=F.upper(t["NNAME"]), TWICE=t["NKEY"] * 2).df.where("RKEY >= 2").select("NKEY", "LOUD", "TWICE")


def _raw_file(spark, name: str, plan, body: bytes) -> str:
    from tidewater.sources.headers import header_bytes

    path = f"{scratch(spark, name)}/{name}.xpt"
    raw = header_bytes(plan, "", "") + body
    with open(path, "wb") as f:
        f.write(raw.ljust(sizes.up(len(raw))))
    return path


def _numeric_plan(*lengths: int):
    from tidewater.model import Plan, Variable

    return Plan("RAW", None, tuple(Variable(f"V{i}", True, n) for i, n in enumerate(lengths))).laid_out()


@query("select null::double as V0, v as V0__missing from (values ('.'), ('._'), ('.A'), ('.Z')) t(v) union all select 1.0, null")
def special_missings(spark, sf_dir):
    body = b"".join(bytes([b]) + bytes(7) for b in (0x2E, 0x5F, 0x41, 0x5A)) + bytes.fromhex("4110000000000000")
    return tables.read(spark, _raw_file(spark, "special", _numeric_plan(8), body), specialMissing=True).df


@query("select * from (values (1.0::double, 100.0::double), (-7.375, 0.5)) v(V0, V1)")
def short_numerics(spark, sf_dir):
    body = bytes.fromhex("4110" + "426400") + bytes.fromhex("C176" + "408000")
    return tables.read(spark, _raw_file(spark, "short", _numeric_plan(2, 3), body)).df


@query("""select p_partkey::bigint as p_partkey, lower(hex(encode(p_brand))) as brand, p_size::bigint as p_size, p_retailprice from part""")
def frame_bridge(spark, sf_dir):
    df = source(spark, sf_dir, "part").select("p_partkey", F.encode("p_brand", "UTF-8").alias("brand"), "p_size", "p_retailprice")
    return bridge.to_frame(bridge.from_frame(df, "PART"))


@query("""select event_id::double as event_id, date_diff('second', timestamp '1960-01-01', date_trunc('second', ts))::double as ts, user_id::double as user_id, value from events""")
def numbers_as_stored(spark, sf_dir):
    return bridge.sas_numbers(source(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value"))


@query("select 'trailing' as rule, 4::bigint as n_rows union all select 'stop', 2")
def blank_rows(spark, sf_dir):
    from tidewater.model import Plan, Variable

    plan = Plan("BLANK", None, (Variable("C", False, 100),)).laid_out()
    path = _raw_file(spark, "blank", plan, b"".join(x.ljust(100) for x in (b"one", b"two", b"", b"four")))
    found = [tables.read(spark, path, blankRows=r).df.agg(F.lit(r).alias("rule"), F.count("*").alias("n_rows")) for r in ("trailing", "stop")]
    return found[0].union(found[1])


@query("select * from (values ('lossy', 'caf' || chr(65533)), ('strict', 'caf' || chr(65533)), ('latin1', 'café')) v(mode, value)")
def text_modes(spark, sf_dir):
    from tidewater.model import Plan, Variable

    path = _raw_file(spark, "modes", Plan("M", None, (Variable("C", False, 6),)).laid_out(), b"caf\xe9  ")
    found = [tables.read(spark, path, textMode=m).df.select(F.lit(m).alias("mode"), F.col("C").alias("value")) for m in ("lossy", "strict", "latin1")]
    return found[0].union(found[1]).union(found[2])


@query("""select * from (values ('LI', 'ORDKEY', 'Num', 1, 'Identifier', 'Req'), ('LI', 'LINENO', 'Num', 2, 'Identifier', 'Req'), ('LI', 'RETFLAG', 'Num', 3, 'Qualifier', 'Req'), ('LI', 'COMMENT', 'Char', 4, null, 'Req'), ('LI', 'QTY', 'Num', 5, 'Topic', 'Exp'),
('NA', 'NKEY', 'Num', 1, 'Identifier', 'Req'), ('NA', 'NNAME', 'Char', 0, 'Topic', 'Perm')) v(dataset, name, type, "order", role, core)""")
def standard_variables(spark, sf_dir):
    found = standards.load_standard(spark, sample_standard.write_sample(scratch(spark, "standard")))
    return found.variables.select("dataset", "name", "type", "order", "role", "core")


@query("""with need(name, expected) as (values ('ORDKEY', 'Num'), ('LINENO', 'Num'), ('RETFLAG', 'Num'), ('COMMENT', 'Char')),
own(name, found) as (values ('ORDKEY', 'Num'), ('LINENO', 'Num'), ('RETFLAG', 'Char'), ('QTY', 'Num'))
select need.name, expected, found, case when found is null then 'missing' else 'type' end as finding from need left join own on need.name = own.name where found is null or found <> expected""")
def standard_conformance(spark, sf_dir):
    found = standards.load_standard(spark, sample_standard.write_sample(scratch(spark, "standard")))
    return standards.conformance(found, "li", back(spark, sf_dir, "lineitem"))


@query("select l_returnflag as RETFLAG, count(*) as n_rows, sum(l_quantity) as sum_qty from lineitem group by 1")
def stream_files(spark, sf_dir):
    """The split files of lineitem as they come into a folder, aggregated by a streaming query until none is left."""
    df = short(spark, sf_dir, "lineitem").select("RETFLAG", "QTY")
    folder = scratch(spark, "stream")
    made = tables.writer(tables.TransportTable(df, "LINEITEM", "Lines"), created=WHEN).max_file_size_gb((1 << 20) / sizes.GIB).finalize()
    made.write_path(f"{folder}/lineitem.xpt")
    name = f"stream_{os.path.basename(folder).replace('-', '_')}"
    sums = files.read_stream(spark, folder, made.plan).groupBy("RETFLAG").agg(F.count("*").alias("n_rows"), F.sum("QTY").alias("sum_qty"))
    running = sums.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{folder}-state").start()
    running.awaitTermination()
    return spark.table(name)


@query("select 2.5::double as low, 9.75::double as high, 3.5::double as third")
def float_vectors(spark, sf_dir):
    """Known byte patterns, read natively."""
    rows = spark.createDataFrame([(struct.pack(">Q", 0x4128000000000000), struct.pack(">Q", 0x419C000000000000), bytes.fromhex("4138"))], "a binary, b binary, c binary")
    return rows.select(ibm.ibm_decode(F.col("a")).alias("low"), ibm.ibm_decode(F.col("b")).alias("high"), ibm.ibm_decode(F.col("c")).alias("third"))


@query("select c_custkey as id, c_name as whole, 'a' || chr(65533) || 'b' as mended from customer")
def text_of_bytes(spark, sf_dir):
    rows = source(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("id"), text.text_of_bytes(F.encode("c_name", "UTF-8")).alias("whole"), text.text_of_bytes(F.unhex(F.lit("61FF62"))).alias("mended"))


# (name, numeric, length, label) of a plan that breaks the limits that the other one keeps; its name is long, it has no label and says that a row is shorter than it is
LIMITS = [("HALFNUM", True, 4, "A number of four bytes"), ("NOTHING", False, 0, "No room for a value"), ("WORDY", False, 20, "This label goes on for longer than forty bytes do"), ("FINE", True, 8, "Nothing amiss")]


@query(f"""with v(name, num, len, label) as (values {", ".join(f"('{n}', {str(num).lower()}, {size}, '{label}')" for n, num, size, label in LIMITS)}), d(name) as (values ('SHIPMENTS'))
select 'DatasetNameTooLong' as code, 'ERROR' as severity, 'dataset' as target_kind, name as target from d where strlen(name) > 8 union all select 'MissingDatasetLabel', 'WARN', 'dataset', name from d
union all select 'AgencyDatasetNameTooLong', 'ERROR', 'dataset', name from d where strlen(name) > 8 union all select 'DatasetNamePatternMismatch', 'ERROR', 'dataset', name from d where not regexp_full_match(name, '[A-Z][A-Z0-9]{{0,7}}')
union all select 'DatasetNameFileStemMismatch', 'ERROR', 'dataset', name from d where lower(name) <> 'parcels'
union all select 'VariableLabelTooLong', 'ERROR', 'variable', name from v where strlen(label) > 40 union all select 'AgencyLabelTooLong', 'ERROR', 'variable', name from v where strlen(label) > 40
union all select 'NumericWrongLength', 'ERROR', 'variable', name from v where num and len <> 8 union all select 'CharacterLengthTooShort', 'ERROR', 'variable', name from v where not num and len < 1
union all select 'RowLenInconsistent', 'ERROR', null, null from (select sum(len) as total from v) where total <> 30""")
def issues_limits(spark, sf_dir):
    import dataclasses

    from tidewater.model import Plan, Variable

    plan = Plan("SHIPMENTS", None, tuple(Variable(n, num, size, label) for n, num, size, label in LIMITS)).laid_out()
    plan = dataclasses.replace(plan, row_bytes=30)
    return rules.issue_frame(spark, rules.validate(plan, rules.FDA, "/data/parcels.xpt")).select("code", "severity", "target_kind", "target")


@query("select c_custkey::double as CUSTKEY, rpad(c_mktsegment, (select max(strlen(c_mktsegment)) from customer)::int, ' ') as SEGMENT from customer")
def preserve_blanks(spark, sf_dir):
    df = short(spark, sf_dir, "customer").select("CUSTKEY", "SEGMENT")
    return tables.read(spark, written(spark, df, "cust"), preserveBlanks=True).df


@query("select '15JUN24:14:30:45' as created, timestamp '2024-06-15 14:30:45' as parsed")
def header_stamps(spark, sf_dir):
    found = tables.inspect(written(spark, short(spark, sf_dir, "nation"), "nation"))
    return spark.createDataFrame([(found.created, dates.parse_header_stamp(found.created))], "created string, parsed timestamp_ntz")


@query("select 'NATION' as name, count(*) as n_rows, 3 as n_columns from nation union all select 'REGION', count(*), 2 from region")
def folder_of_files(spark, sf_dir):
    """Each file of a folder by its stem."""
    folder = scratch(spark, "folder")
    region = source(spark, sf_dir, "region").select(F.col("r_regionkey").alias("KEY"), F.col("r_name").alias("NAME"))
    for name, df in (("nation", short(spark, sf_dir, "nation")), ("region", region)):
        tables.writer(tables.TransportTable(df, name.upper(), name), created=WHEN).finalize().write_path(f"{folder}/{name}.xpt")
    found = tables.batch_folder(spark, folder)
    return spark.createDataFrame([(t.name, t.count(), len(t)) for t in found.values()], "name string, n_rows long, n_columns int")


@query("select (9 * 80 + ceil(3 * 140 / 80.0) * 80 + ceil(count(*) * (16 + max(strlen(n_name))) / 80.0) * 80)::bigint as bytes, false as empty from nation")
def file_as_bytes(spark, sf_dir):
    table = tables.TransportTable(short(spark, sf_dir, "nation"), "NATION", "Nations")
    return spark.createDataFrame([(len(tables.writer(table, created=WHEN).finalize().to_bytes()), table.is_empty())], "bytes long, empty boolean")


@query("select * from (values (0, 'NKEY', 'NKEY (Numeric)'), (1, 'NNAME', 'NNAME (Character)'), (2, 'RKEY', 'RKEY (Numeric)')) v(place, name, described)")
def column_names(spark, sf_dir):
    t = tables.read(spark, written(spark, short(spark, sf_dir, "nation"), "nation"))
    return spark.createDataFrame([(i, n, t.describe_column(n)) for i, n in enumerate(t.names())], "place int, name string, described string")


@query("""select count(*) as n_rows, count(distinct (l_orderkey, l_linenumber)) as n_distinct, sum(l_quantity) as sum_qty, min(l_orderkey)::double as first_key, max(l_orderkey)::double as last_key, 0::bigint as out_of_order from lineitem""")
def split_ordered(spark, sf_dir):
    """lineitem in order over many files: every row once, and the files one after the other in order (rows with the same key may be in two)."""
    df = short(spark, sf_dir, "lineitem").select("ORDKEY", "LINENO", "QTY")
    path = f"{scratch(spark, 'ordered')}/line.xpt"
    made = tables.writer(tables.TransportTable(df, "LINE", "Lines"), created=WHEN, order_by=["ORDKEY", "LINENO"]).max_file_size_gb((1 << 18) / sizes.GIB).finalize()
    paths = made.write_path(path)
    rows = tables.read(spark, paths, fileId=True).df.withColumnRenamed("_file_id", "file")
    edges = rows.groupBy("file").agg(F.min(F.struct("ORDKEY", "LINENO")).alias("low"), F.max(F.struct("ORDKEY", "LINENO")).alias("high"))
    wrong = edges.alias("a").join(edges.alias("b"), F.expr("b.file = a.file + 1 and b.low < a.high")).agg(F.count("*").alias("out_of_order"))
    sums = rows.agg(F.count("*").alias("n_rows"), F.countDistinct("ORDKEY", "LINENO").alias("n_distinct"), F.sum("QTY").alias("sum_qty"), F.min("ORDKEY").alias("first_key"), F.max("ORDKEY").alias("last_key"))
    return sums.withColumn("one", F.lit(1)).join(wrong.withColumn("one", F.lit(1)), "one").drop("one")  # a row each


@query("""select 'SEND' as kind, * from (values ('LI', 'ORDKEY', 'Num', 1), ('LI', 'LINENO', 'Num', 2), ('LI', 'RETFLAG', 'Num', 3), ('LI', 'COMMENT', 'Char', 4), ('LI', 'QTY', 'Num', 5), ('NA', 'NKEY', 'Num', 1), ('NA', 'NNAME', 'Char', 0)) v(dataset, name, type, "order")
union all select 'ADAM', * from (values ('LI', 'ORDKEY', 'Num', 1), ('LI', 'LINENO', 'Num', 2), ('LI', 'RETFLAG', 'Num', 3), ('LI', 'COMMENT', 'Char', 4), ('LI', 'QTY', 'Num', 5), ('NA', 'NKEY', 'Num', 6), ('NA', 'NNAME', 'Char', 7)) v(dataset, name, type, "order")""")
def other_standards(spark, sf_dir):
    found = [standards.load_standard(spark, sample_standard.write_sample(scratch(spark, "standard"), kind)).variables.select(F.lit(kind).alias("kind"), "dataset", "name", "type", "order") for kind in ("SEND", "ADAM")]
    return found[0].union(found[1])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xpt_aggregate_lineitem(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
