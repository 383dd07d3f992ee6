"""Files: bytes, round trips, splitting, several members, odd content."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewater import queries
from tidewater.model import V8, CorruptError, Format, MemberNotFoundError, Plan, SchemaError, UnsupportedVersionError, ValidationError, Variable, VariableMetadata
from tidewater.operators import bridge, tables
from tidewater.plans import planner, rules, sizes
from tidewater.sources import headers
from tidewater.streaming import files

WHEN = dt.datetime(2024, 6, 15, 14, 30, 45)


def save(df, path, name="AE", label="Adverse Events", **options):
    return tables.writer(tables.TransportTable(df, name, label), created=WHEN, **options).finalize().write_path(str(path))


def raw_file(path, plan, body):
    raw = headers.header_bytes(plan, "", "") + body
    path.write_bytes(raw.ljust(sizes.up(len(raw))))
    return str(path)


def test_layout_of_a_file(spark, tmp_path):
    df = planner.with_metadata(spark.createDataFrame([("001", 1.0), ("002", None)], "USUBJID string, AESEQ double"), "AESEQ", label="Sequence", format="8.2")
    (path,) = save(df.coalesce(1), tmp_path / "ae.xpt")
    raw = open(path, "rb").read()
    assert len(raw) % 80 == 0 and raw[:80] == headers.LIBRARY and raw[240:320] == headers.MEMBER and raw[320:400] == headers.MEMBER_DATA
    assert raw[80:160] == b"SAS     SAS     SASLIB  9.4     " + b" " * 32 + b"15JUN24:14:30:45"
    assert raw[400:480] == b"SAS     AE      SASDATA 9.4     " + b" " * 32 + b"15JUN24:14:30:45" and raw[480:560] == b"15JUN24:14:30:45".ljust(32) + b"Adverse Events".ljust(48)
    assert raw[560:640] == headers.DESCRIPTORS + b"0002" + b"0" * 20 + b"  "
    first, second = raw[640:780], raw[780:920]
    assert first[:8] == bytes([0, 2, 0, 0, 0, 3, 0, 1]) and first[8:16] == b"USUBJID " and first[84:88] == bytes(4)
    assert second[:8] == bytes([0, 1, 0, 0, 0, 8, 0, 2]) and second[16:56] == b"Sequence".ljust(40) and second[56:64] == b" " * 8 and second[64:70] == bytes([0, 8, 0, 2, 0, 1]) and second[84:88] == bytes([0, 0, 0, 3])
    assert raw[960:1040] == headers.OBSERVATIONS and raw[1040:] == (b"001" + bytes.fromhex("4110000000000000") + b"002" + b"\x2e" + bytes(7)).ljust(80)


def test_round_trip_of_all_types(spark, tmp_path):
    df = spark.sql("""select * from values (1, 2.5d, true, date'1960-01-02', timestamp_ntz'1959-12-31 23:59:58.5', 'héllo', cast('ab' as binary)), (null, null, null, null, null, null, null),
      (-7, 1e-10d, false, date'2024-01-15', timestamp_ntz'2024-01-15 00:00:01', '  lead', cast('' as binary)) as t(I, D, B, DT, TS, S, X)""")
    (path,) = save(df.coalesce(1), tmp_path / "t.xpt", "T")
    got = [tuple(r) for r in tables.read(spark, path).df.collect()]
    assert got == [(1.0, 2.5, 1.0, 1.0, -1.0, "héllo", "ab"), (None,) * 7, (-7.0, 1e-10, 0.0, 23390.0, 2020809601.0 + 0 * 1, "  lead", None)] or got[2][4] == (dt.datetime(2024, 1, 15, 0, 0, 1) - dt.datetime(1960, 1, 1)).total_seconds()
    (path,) = save(df.coalesce(1), tmp_path / "u.xpt", "T", variables=[VariableMetadata("DT", numeric=False), VariableMetadata("TS", numeric=False)])
    assert [(r["DT"], r["TS"]) for r in tables.read(spark, path).df.collect()][2] == ("2024-01-15", "2024-01-15T00:00:01")


def test_metadata_survives(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "STUDYID string, AESTDTC double")
    df = planner.with_metadata(df, "STUDYID", label="Study", format=Format.character(20), length=20)
    df = planner.with_metadata(df, "AESTDTC", label="Start", format="DATE9.", informat="DATE9.")
    (path,) = save(df, tmp_path / "ae.xpt")
    t = tables.read(spark, path)
    one, two = (f.metadata for f in t.df.schema)
    assert t.name == "AE" and t.label == "Adverse Events"
    assert one == {"transport.label": "Study", "transport.format": "CHAR20.", "transport.length": 20} and two == {"transport.label": "Start", "transport.format": "DATE9.", "transport.informat": "DATE9."}


def test_rows_are_in_order_over_many_partitions(spark, tmp_path):
    (path,) = save(spark.range(0, 5000, 1, 7).select(F.col("id").cast("double").alias("A")), tmp_path / "a.xpt", "A")
    got = tables.read(spark, path, rowsPerPartition=333, rowId=True).df.collect()
    assert all(r["A"] == r["_row_id"] for r in got) and len(got) == 5000
    assert tables.read(spark, path, rowLimit=41, rowsPerPartition=10).df.count() == 41


def test_empty_table(spark, tmp_path):
    (path,) = save(spark.createDataFrame([], "A double, B string"), tmp_path / "e.xpt", "E")
    assert tables.read(spark, path).df.collect() == [] and tables.inspect(path).members[0].rows == 0


def test_split(spark, tmp_path):
    df = spark.range(0, 1000, 1, 5).select(F.col("id").cast("double").alias("A"), F.lit("x" * 12).alias("B"))
    made = tables.writer(tables.TransportTable(df, "A", "l"), created=WHEN).max_file_size_gb(4000 / sizes.GIB).finalize()
    paths = made.write_path(str(tmp_path / "a.xpt"))
    assert [os.path.basename(p) for p in paths][:2] == ["a_001.xpt", "a_002.xpt"] and all(os.path.getsize(p) <= 4000 for p in paths)
    assert [r["A"] for p in paths for r in tables.read(spark, p).df.collect()] == [float(i) for i in range(1000)]
    assert sorted(r["A"] for r in tables.read(spark, str(tmp_path / "a_0*.xpt")).df.collect()) == [float(i) for i in range(1000)]
    with pytest.raises(SchemaError):
        tables.writer(tables.TransportTable(df, "A", "l")).max_file_size_gb(900 / sizes.GIB).finalize().write_path(str(tmp_path / "b.xpt"))
    assert len(tables.writer(tables.TransportTable(df, "A", "l")).finalize().to_bytes()) == sizes.file_size(made.plan, 1000)


def test_many_files_are_one_scan(spark, tmp_path):
    """a union of one scan for each file outgrows the driver."""
    (tmp_path / "sf").mkdir()
    df = spark.range(0, 1500, 1, 3).selectExpr("id as c_custkey", "concat('Customer ', id) as c_name", "id % 25 as c_nationkey", "double(id) as c_acctbal", "'BUILDING' as c_mktsegment")
    df.write.parquet(str(tmp_path / "sf/customer.parquet"))
    got = queries.split_roundtrip(spark, str(tmp_path / "sf"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("transport") == 1
    assert sorted(r["CUSTKEY"] for r in got.collect()) == [float(i) for i in range(1500)]


def test_many_files_keep_their_order(spark, tmp_path):
    df = spark.range(0, 1010, 1, 2).select(F.col("id").cast("double").alias("A"))
    paths = tables.writer(tables.TransportTable(df, "A", "l"), created=WHEN).max_file_size_gb(960 / sizes.GIB).finalize().write_path(str(tmp_path / "a.xpt"))
    want = [(i // 10, float(i)) for i in range(1010)]
    assert len(paths) == 101
    for more in ({}, {"blankRows": "stop"}, {"rowsPerPartition": 3}):
        got = tables.read(spark, paths, fileId=True, rowId=True, **more).df
        assert [(r["_file_id"], r["A"]) for r in got.collect()] == want and {r[0] for r in got.select("_row_id").distinct().collect()} == set(range(10))
        assert got.where("A >= 555").count() == 455
    assert tables.read(spark, paths[3:], rowLimit=25).df.count() == 25
    assert [r["A"] for r in tables.read(spark, paths[::-1]).df.collect()][:11] == [*map(float, range(1000, 1010)), 990.0]
    for k in (999, 1000, 1001):
        os.rename(paths[k - 999], tmp_path / f"b_{k}.xpt")
    assert [r["A"] for r in tables.read(spark, str(tmp_path / "b_*.xpt")).df.collect()] == [float(i) for i in range(30)]


def test_a_key_in_two_files_is_in_order(spark, tmp_path):
    """rows with the same key on both sides of a cut counted as out of order."""
    spark.sql("select 7L as l_orderkey, 1 as l_linenumber, double(id % 50) as l_quantity from range(0, 25000, 1, 3)").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [r.asDict() for r in queries.split_ordered(spark, str(tmp_path)).collect()] == [{"n_rows": 25000, "n_distinct": 1, "sum_qty": 25000 * 24.5, "first_key": 7.0, "last_key": 7.0, "out_of_order": 0}]


def test_members(spark, tmp_path):
    one = open(save(spark.createDataFrame([(1.0,)], "A double"), tmp_path / "a.xpt", "AA")[0], "rb").read()
    two = open(save(spark.createDataFrame([("x",)] * 30, "B string"), tmp_path / "b.xpt", "BB")[0], "rb").read()
    (tmp_path / "c.xpt").write_bytes(one + two[240:])
    path = str(tmp_path / "c.xpt")
    assert tables.inspect(path).names() == ["AA", "BB"] and [t.df.count() for t in tables.read_all(spark, path)] == [1, 30]
    assert tables.read(spark, path, member="bb").df.columns == ["B"]
    with pytest.raises(MemberNotFoundError):
        tables.read(spark, path, member="nope")
    assert sorted(tables.batch_folder(spark, str(tmp_path))) == ["a", "b", "c"]


def test_odd_content(spark, tmp_path):
    text = Plan("T", None, (Variable("C", False, 100),)).laid_out()
    blank = raw_file(tmp_path / "blank.xpt", text, b"".join(x.ljust(100) for x in (b"one", b"", b"three")))
    assert [r["C"] for r in tables.read(spark, blank).df.collect()] == ["one", None, "three"]
    assert tables.read(spark, blank, blankRows="stop").df.count() == 1
    cut = raw_file(tmp_path / "cut.xpt", text, b"a".ljust(100) + b"b" * 130)
    assert tables.read(spark, cut).df.count() == 2
    with pytest.raises(Exception, match="incomplete"):
        tables.read(spark, cut, mode="FAILFAST").df.count()
    short = raw_file(tmp_path / "short.xpt", Plan("T", None, (Variable("N", True, 3),)).laid_out(), bytes.fromhex("426400"))
    assert tables.read(spark, short).df.first()["N"] == 100.0
    special = raw_file(tmp_path / "special.xpt", Plan("T", None, (Variable("N", True, 8),)).laid_out(), b"A" + bytes(7) + bytes.fromhex("4110000000000000"))
    assert [tuple(r) for r in tables.read(spark, special, specialMissing=True).df.collect()] == [(None, ".A"), (1.0, None)]
    bare = save(planner.with_metadata(spark.createDataFrame([(1.0,)], "A double"), "A", format="8.2"), tmp_path / "bare.xpt", "B")[0]
    assert "transport.format" not in tables.read(spark, bare).df.schema[0].metadata and tables.read(spark, bare, bareFormats=True).df.schema[0].metadata["transport.format"] == "8.2"
    latin = raw_file(tmp_path / "latin.xpt", Plan("T", None, (Variable("C", False, 4),)).laid_out(), b"caf\xe9")
    assert tables.read(spark, latin, textMode="latin1").df.first()[0] == "café" and tables.read(spark, latin, textMode="strict").df.first()[0] == "caf�"
    with pytest.raises(Exception, match="decode"):
        tables.read(spark, latin, textMode="strict", mode="FAILFAST").df.collect()
    keep = raw_file(tmp_path / "keep.xpt", Plan("T", None, (Variable("C", False, 4),)).laid_out(), b"ab  ")
    assert tables.read(spark, keep, preserveBlanks=True).df.first()[0] == "ab  "


def test_corrupt_files(spark, tmp_path):
    for name, raw in (("empty", b""), ("noise", b"x" * 200), ("head", headers.LIBRARY + b" " * 160 + headers.MEMBER + b"y" * 80)):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(CorruptError):
            tables.inspect(str(tmp_path / name))
    (tmp_path / "none").write_bytes(headers.LIBRARY + b" " * 160)
    with pytest.raises(CorruptError):
        tables.read(spark, str(tmp_path / "none"))


def test_columns_option_reads_less(spark, tmp_path):
    path = save(spark.createDataFrame([(1.0, "x", 2.0)], "A double, B string, C double"), tmp_path / "a.xpt", "A")[0]
    assert tables.read(spark, path, columns="C,B").df.columns == ["C", "B"]


def test_writer_checks(spark):
    t = tables.TransportTable(spark.createDataFrame([(1.0,)], "toolongname double"), "AE", "x")
    with pytest.raises(ValidationError, match="exceeds 8 bytes"):
        tables.writer(t).finalize()
    loose = tables.writer(t, strict=False).agency(rules.FDA).finalize()
    assert loose.has_errors() and loose.has_warnings() and loose.issue_frame().count() == len(loose.issues) and loose.max_bytes == 5 * sizes.GIB
    with pytest.raises(UnsupportedVersionError):
        tables.writer(t).xpt_version(V8).finalize()
    for f in (lambda: tables.read_v8("x"), lambda: tables.write_v8(t, "x")):
        with pytest.raises(UnsupportedVersionError):
            f()
    fixed = tables.writer(tables.TransportTable(spark.createDataFrame([(1.0,)], "aeseq double"), "ae", "x"), fix_names=True).agency(rules.FDA).finalize()
    assert fixed.plan.name == "AE" and fixed.plan.variables[0].name == "AESEQ" and fixed.to_bytes()
    with pytest.raises(SchemaError):
        headers.header_bytes(Plan("A", None, tuple(Variable(f"V{i}", True, 8) for i in range(10_000))), "", "")
    with pytest.raises(SchemaError):
        headers.pack_variable(Variable("A", False, 40_000), 1)


def test_table_wrapper(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "A double, B string")
    t = tables.TransportTable(df, "AE")
    assert t.describe() == "AE [2 rows × 2 cols]" and len(t) == 2 and t.names() == ["A", "B"] and t.count() == 2 and [f.name for f in t] == ["A", "B"]
    assert t.column("a") is None and t.extend(C=t["A"] + t[0]).df.agg(F.sum("C")).first()[0] == 6.0
    with pytest.raises(KeyError):
        t["a"]
    assert t.append(t).count() == 4
    with pytest.raises(SchemaError):
        t.append(tables.TransportTable(df.select("B", "A"), "X"))


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    df = spark.range(10).select(F.col("id").cast("double").alias("A"))
    made = tables.writer(tables.TransportTable(df, "A", "l")).finalize()
    made.write_path(str(folder / "a.xpt"))
    made.write_path(str(folder / "b.xpt"))
    q = files.read_stream(spark, str(folder), made.plan).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert spark.table("streamed").agg(F.count("*"), F.sum("A")).first()[:] == (20, 90.0)


def test_bridge(spark):
    df = spark.sql("select cast(1 as tinyint) as i, cast(0.5 as float) as f, cast('Ab' as binary) as b, date'1960-01-03' as d")
    t = bridge.from_frame(df, "T")
    assert [f.dataType.simpleString() for f in t] == ["bigint", "double", "binary", "date"] and bridge.to_frame(t).first()["b"] == "4162"
    assert t.describe_column("i") == "i (Numeric)" and t.describe_column("b") == "b (Character)"
    assert bridge.sas_numbers(df).first()["d"] == 2.0
    with pytest.raises(SchemaError):
        bridge.from_frame(spark.sql("select 1.5bd as x"), "T")


def test_fixed_width():
    import pyarrow as pa

    from tidewater.sources.transport import fixed_width

    rows = fixed_width(pa.array(["skipped", "ab", None, "", "héllo", "longer text"]).slice(1), 4)
    assert [bytes(r) for r in rows] == [b"ab  ", b"    ", b"    ", b"h\xc3\xa9l", b"long"]
    assert fixed_width(pa.array([], pa.string()), 3).shape == (0, 3)


@pytest.fixture(params=["true", "false"])
def many_partitions(spark, request):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["ordered", "grouped", "dealt"])
def test_split_writes_lose_nothing(spark, tmp_path, many_partitions, kind):
    """Rows of shuffled inputs come back once each, whatever the partitions are when the input is computed."""
    n = 300_000
    wide = [F.col("A"), F.format_string("%012d", F.col("A").cast("long")).alias("B"), *[(F.col("A") * k).alias(f"N{k}") for k in range(8)], F.lit("x" * 40).alias("C")]
    base = spark.range(0, n, 1, 9).select(F.col("id").cast("double").alias("A")).select(*wide)
    if kind == "grouped":
        base = base.groupBy("A").agg(*[F.first(c).alias(c) for c in base.columns[1:]])
    elif kind == "dealt":
        base = base.repartition(33)
    made = tables.writer(tables.TransportTable(base, "A", "l"), created=WHEN, order_by=["A"] if kind == "ordered" else []).max_file_size_gb(2_000_000 / sizes.GIB).finalize()
    paths = made.write_path(str(tmp_path / "a.xpt"))
    assert len(paths) > 10 and all(os.path.getsize(p) <= 2_000_000 for p in paths) and sorted(os.listdir(tmp_path)) == sorted(os.path.basename(p) for p in paths)
    got = tables.read(spark, str(tmp_path / "a_*.xpt")).df
    assert got.agg(F.count("*"), F.countDistinct("A"), F.min("A"), F.max("A"), F.sum(F.when(F.col("B").cast("double") == F.col("A"), 1)), F.sum(F.when(F.col("N7") == 7 * F.col("A"), 1))).first() == (n, n, 0.0, n - 1.0, n, n)
    if kind == "ordered":
        first = 0
        for p in paths:
            rows = [r["A"] for r in tables.read(spark, p, columns="A").df.collect()]
            assert rows == list(range(first, first + len(rows)))
            first += len(rows)
        assert first == n


def test_headers_alone_are_read(spark, tmp_path, monkeypatch):
    """The driver's share of a large file is its headers and its end, however many rows there are."""
    from tidewater.sources import storage, transport

    paths = [save(spark.range(n).select(F.col("id").cast("double").alias("A")), tmp_path / f"{n}.xpt", "A")[0] for n in (1000, 40_000)]
    monkeypatch.setattr(tables, "SEARCH", 4000)
    monkeypatch.setattr(transport, "SEARCH", 4000)
    seen, plain = [], storage.open_input

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            return self.f.seek(at)

        def read(self, *n):
            got = self.f.read(*n)
            seen[-1] += len(got)
            return got

    places = [tables.find_members(spark, [p]) for p in paths]
    monkeypatch.setattr(storage, "open_input", lambda p: Counting(plain(p)))
    for p, found in zip(paths, places, strict=True):
        seen.append(0)
        assert transport.inspect_file(p, places=found[p]).members[0].rows in (1000, 40_000)
    assert seen[0] == seen[1] < 2500
    monkeypatch.undo()
    monkeypatch.setattr(tables, "SEARCH", 4000)
    blank = raw_file(tmp_path / "blank.xpt", Plan("T", None, (Variable("C", False, 100),)).laid_out(), b"".join(x.ljust(100) for x in [b"one"] * 70 + [b""] + [b"three"] * 30))
    assert tables.read(spark, blank, blankRows="stop").df.count() == 70 and tables.read(spark, blank).df.count() == 101
    one = open(paths[0], "rb").read()
    (tmp_path / "two.xpt").write_bytes(one + open(paths[1], "rb").read()[240:])
    both = str(tmp_path / "two.xpt")
    assert [m.rows for m in tables.inspect(both).members] == [1000, 40_000]
    assert tables.read(spark, both, member="A").df.count() == 1000


def test_members_on_chunk_borders():
    raw = b"".join([b"x" * 80 * 3, headers.MEMBER, b"y" * 85, headers.MEMBER, b"z" * 75, headers.MEMBER])
    want = [240, 240 + 80 + 85 + 80 + 75]
    for step in (1, 7, 80, 81, 1000):
        assert list(headers.member_places((raw[i : i + step] for i in range(0, len(raw), step)), 0)) == want
    assert list(headers.member_places([raw[80:]], 80)) == want


def test_pushed_filters(spark, tmp_path):
    df = spark.createDataFrame([(float(i), f"s{i % 5}" if i % 7 else None) for i in range(300)], "A double, B string")
    path = save(df.coalesce(1), tmp_path / "f.xpt", "F")[0]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda **o: tables.read(spark, path, rowId=True, **o).df
        for where in ("A > 100 and B = 's3'", "A <= 7.5", "B is null", "B in ('s1', 's2') and A >= 50", "A < 10 and B is not null", "_row_id > 290", "A = 5 or B = 's1'"):
            assert sorted(map(repr, read(pushFilters=True).where(where).collect())) == sorted(map(repr, read().where(where).collect()))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_zoned_timestamps_are_local(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp'2024-01-15 00:00:01' as TS, timestamp'2024-07-15 12:00:00' as TT")
        made = save(df, tmp_path / "z.xpt", "Z", variables=[VariableMetadata("TT", numeric=False)])[0]
        stored = tables.read(spark, made).df.first()
        numbers = bridge.sas_numbers(df).first()
        assert stored["TS"] == numbers["TS"] == (dt.datetime(2024, 1, 15, 0, 0, 1) - dt.datetime(1960, 1, 1)).total_seconds() and stored["TT"] == "2024-07-15T12:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stream_of_libraries(spark, tmp_path):
    """All members of a file are read; one with other variables has to be left out by name."""
    one = open(save(spark.createDataFrame([(1.0,)], "A double"), tmp_path / "a.xpt", "AA")[0], "rb").read()
    two = open(save(spark.createDataFrame([(2.0,), (3.0,)], "A double"), tmp_path / "b.xpt", "BB")[0], "rb").read()
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "both.xpt").write_bytes(one + two[240:])
    plan = tables.inspect(str(folder / "both.xpt")).members[0].plan
    for member, want in ((None, [1.0, 2.0, 3.0]), ("bb", [2.0, 3.0])):
        name = f"feed_{member}"
        files.read_stream(spark, str(folder), plan, member).writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r["A"] for r in spark.table(name).collect()) == want
