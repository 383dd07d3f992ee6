"""Floats, text, dates and formats."""

import datetime as dt
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import dates, ibm, text
from tidewater.model import LEFT, RIGHT, Format, FormatError, TransportError

VECTORS = {1.0: "4110000000000000", 100.0: "4264000000000000", 0.1: "401999999999999a", 123.456: "427b74bc6a7ef9dc", -3.14159: "c13243f3e0370cdc", 2.0**-257: "0" * 16, 2.0**-256: "0110000000000000", 2.0**252: "7f" + "f" * 14, -(2.0**252): "f" * 16, 0.0: "0" * 16, -0.0: "0" * 16, math.nan: "2e" + "0" * 14, math.inf: "2e" + "0" * 14}


def plain_encode(x: float) -> bytes:
    """By the definition, one digit at a time."""
    if not math.isfinite(x):
        return ibm.MISSING
    a = abs(x)
    if a < 2.0**-256:
        return bytes(8)
    if a >= 2.0**252:
        return bytes([0xFF if x < 0 else 0x7F]) + b"\xff" * 7
    power = 0
    while a >= 16.0**power:
        power += 1
    while a < 16.0 ** (power - 1):
        power -= 1
    return struct.pack(">Q", ((power + 64) | (128 if x < 0 else 0)) << 56 | int(a * 2.0 ** (56 - 4 * power)))


def test_known_floats(spark):
    values = list(VECTORS)
    assert [bytes(r).hex() for r in ibm.encode_array(np.array(values))] == list(VECTORS.values())
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", F.hex(ibm.ibm_encode(F.col("x")))).collect()
    assert [r[1].lower() for r in sorted(rows)] == list(VECTORS.values())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=50))
def test_encoding_follows_the_definition(xs):
    assert [bytes(r) for r in ibm.encode_array(np.array(xs))] == [plain_encode(x) for x in xs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(min_value=1e-70, max_value=1e70) | st.floats(min_value=-1e70, max_value=-1e-70), min_size=1))
def test_round_trip_is_exact(xs):
    value, missing, _ = ibm.decode_array(ibm.encode_array(np.array(xs)))
    assert value.tolist() == xs and not missing.any()


def test_native_and_numpy_agree(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.standard_normal(300) * 16.0 ** rng.integers(-60, 60, 300), 16.0 ** np.arange(-60, 60), np.nextafter(16.0 ** np.arange(-60, 60), 0)])
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").withColumn("b", ibm.ibm_encode(F.col("x"))).withColumn("y", ibm.ibm_decode(F.col("b"))).orderBy("i").collect()
    assert [bytes(r["b"]) for r in rows] == [bytes(b) for b in ibm.encode_array(xs)]
    assert [r["y"] for r in rows] == xs.tolist()


def test_decoding_truncates(spark):
    raw = ["41ffffffffffffff", "41fffffffffffff9", "c1ffffffffffffff", "4113ffffffffffff"]
    want = [15.999999999999998, 15.999999999999998, -15.999999999999998, None]
    got = ibm.decode_array(np.array([list(bytes.fromhex(r)) for r in raw], np.uint8))[0].tolist()
    assert got[:3] == want[:3]
    native = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").orderBy("i").select(ibm.ibm_decode(F.unhex("r"))).collect()]
    assert native == got


def test_missing_codes(spark):
    for first, kind in [(0x2E, "."), (0x5F, "._"), *((c, f".{chr(c)}") for c in range(65, 91))]:
        raw = np.array([[first] + [0] * 7], np.uint8)
        assert ibm.decode_array(raw)[1][0]
        row = spark.range(1).select(ibm.missing_kind(F.unhex(F.lit(bytes(raw[0]).hex()))), ibm.encode_missing(F.lit(kind))).first() if first in (0x2E, 0x5F, 65, 90) else None
        assert row is None or (row[0] == kind and bytes(row[1]) == bytes(raw[0]))
    assert not ibm.decode_array(np.array([[0x41, 1, 0, 0, 0, 0, 0, 0]], np.uint8))[1][0]


def test_text(spark):
    assert text.decode_text(b"caf\xe9 ", text.LATIN1) == "café"
    assert text.decode_text(b"caf\xe9 ") == "caf�"
    assert text.decode_text(b"caf\xe9", text.STRICT) == "caf�"
    with pytest.raises(UnicodeDecodeError):
        text.decode_text(b"caf\xe9", text.STRICT, fail=True)
    assert text.decode_text(b"    ") is None and text.decode_text(b"ab ", keep_blanks=True) == "ab "
    assert text.decode_text("x\x1c".encode()) == "x\x1c"
    assert text.encode_text("é") == b"\xc3\xa9" and text.encode_text("e", True) == b"e"
    with pytest.raises(TransportError):
        text.encode_text("é", True)
    assert text.fit_bytes("héllo".encode(), 2) == b"h\xc3" and text.cut_text("héllo", 2) == "h"
    words = ["héllo", "有害事象", "😀😀", "plain", "", "é" * 30]
    for most in (1, 2, 3, 4, 5, 7, 8, 40):
        got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(text.truncate_text(F.col("w"), most)).collect()
        assert [r[0] for r in got] == [text.cut_text(w, most) for w in words]
    row = spark.createDataFrame([("é", None)], "a string, b string").select(text.pad_text(F.col("a"), 4), text.pad_text(F.col("b"), 3), text.is_ascii(F.col("a")), text.is_printable(F.lit("a\n"))).first()
    assert [bytes(row[0]), bytes(row[1]), row[2], row[3]] == [b"\xc3\xa9  ", b"   ", False, False]


def test_dates(spark):
    days = [("1960-01-01", 0), ("1960-01-02", 1), ("1959-12-31", -1), ("2024-01-15", 23390)]
    for day, n in days:
        row = spark.range(1).select(dates.sas_days(F.lit(day).cast("date")), dates.date_of_sas(F.lit(n))).first()
        assert row[0] == n and str(row[1]) == day
    row = spark.range(1).select(dates.sas_seconds(F.lit("1959-12-31 23:59:58.5").cast("timestamp_ntz")), dates.date_of_sas(F.lit(10**9)), dates.time_of_sas(F.lit(86400)), dates.time_of_sas(F.lit(3661)), dates.stamp_of_sas(F.lit(10**17))).first()
    assert list(row) == [-1, None, None, "01:01:01", None]
    when = dt.datetime(2024, 6, 15, 14, 30, 45)
    assert dates.header_stamp(when) == "15JUN24:14:30:45" and dates.parse_header_stamp("15JUN24:14:30:45") == when and dates.parse_header_stamp("15JUN2024:14:30:45") == when
    assert dates.parse_header_stamp("nonsense") is None


def test_formats():
    shown = {"DATE9.": "DATE9.", "8.2": "8.2", "8.": "8.", "date9.": "DATE9.", " $CHAR200. ": "$CHAR200.", "8.0": "8."}
    for given_, want in shown.items():
        assert str(Format.parse(given_)) == want
    for bad in ("", "DATE", ".2", "DATE.", "8.x", "$.", "70000."):
        with pytest.raises(FormatError):
            Format.parse(bad)
    assert Format.parse("$CHAR20.").justification == LEFT and Format.parse("DATE9.").justification == RIGHT
    assert Format.from_descriptor("CHAR", -1, -2, 1) == Format("CHAR", 0, 0, RIGHT) and Format.from_descriptor("CHAR", 1, 0, 0).is_character
    assert Format().width == 8 and str(Format.character(20)) == "$CHAR20." and Format.character(20).bare_name == "CHAR"
    assert Format.numeric(8, 2).with_justification(LEFT).justification == LEFT
