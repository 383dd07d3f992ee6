"""IBM hexadecimal floating point, as column expressions and as numpy kernels.

A number is sign, base-16 exponent (excess 64) and a 56-bit fraction. Encoding a double is exact within
range; decoding drops what exceeds 53 bits (it doesn't round). Missing is ``2E``, ``5F`` or ``41`` to ``5A``
before seven zero bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = bytes([0x2E]) + bytes(7)
LEAST, MOST = 2.0**-256, 2.0**252


def encode_array(values: np.ndarray) -> np.ndarray:
    """Doubles to an (n, 8) byte matrix; NaN and infinities are missing."""
    x = np.asarray(values, np.float64)
    a = np.abs(x)
    mantissa, exponent = np.frexp(np.where(np.isfinite(a), a, 0.0))
    power = -(-exponent // 4)  # 16^(power - 1) <= a < 16^power
    whole = np.ldexp(mantissa, exponent - 4 * power + 56).astype(np.uint64)
    bits = ((power + 64).astype(np.uint64) & np.uint64(0x7F)) << np.uint64(56) | whole
    bits = np.where(a < LEAST, np.uint64(0), bits)
    bits = np.where(a >= MOST, np.uint64(0x7FFFFFFFFFFFFFFF), bits)
    bits = np.where(np.signbit(x) & (a >= LEAST), bits | np.uint64(1 << 63), bits)
    bits = np.where(np.isfinite(x), bits, np.uint64(0x2E << 56))
    return bits.astype(">u8").view(np.uint8).reshape(-1, 8)


def decode_array(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, 8) bytes to doubles, whether missing, and the first byte."""
    bits = np.ascontiguousarray(rows).view(">u8").reshape(-1).astype(np.uint64)
    first = (bits >> np.uint64(56)).astype(np.int64)
    whole = bits & np.uint64((1 << 56) - 1)
    missing = (whole == 0) & ((first == 0x2E) | (first == 0x5F) | ((first >= 0x41) & (first <= 0x5A)))
    for limit, mask in ((55, 7), (54, 3), (53, 1)):
        big = (whole >> np.uint64(limit)) > 0
        whole = np.where(big, whole & ~np.uint64(mask), whole)
    value = np.ldexp(whole.astype(np.float64), 4 * ((first & 0x7F) - 64 - 14))
    return np.where((first & 0x80) > 0, -value, value) + 0.0, missing, first


def ibm_encode(value: Column) -> Column:
    """Binary(8) of a double."""
    x = value.cast("double")
    a = F.abs(x)
    guess = (F.floor(F.log2(a) / 4) + 1).cast("int")
    power = F.when(a >= F.pow(F.lit(16.0), guess), guess + 1).when(a < F.pow(F.lit(16.0), guess - 1), guess - 1).otherwise(guess)
    fraction = (a * F.pow(F.lit(16.0), F.lit(14) - power)).cast("long")
    lead = power + 64 + F.when(x < 0, 128).otherwise(0)
    usual = F.unhex(F.concat(F.lpad(F.hex(lead.cast("long")), 2, "0"), F.lpad(F.hex(fraction), 14, "0")))
    full = F.unhex(F.concat(F.when(x < 0, "FF").otherwise("7F"), F.lit("F" * 14)))
    return (
        F.when(x.isNull() | F.isnan(x) | (a == float("inf")), F.unhex(F.lit("2E" + "0" * 14)))
        .when(a < LEAST, F.unhex(F.lit("0" * 16)))
        .when(a >= MOST, full)
        .otherwise(usual)
    )


def missing_kind(raw: Column) -> Column:
    """``.``, ``._`` or ``.A`` to ``.Z`` of a missing value's bytes; null for a number."""
    text = F.hex(raw)
    code = F.conv(F.substring(text, 1, 2), 16, 10).cast("int")
    letter = F.concat(F.lit("."), F.chr(code.cast("long")))
    kind = F.when(code == 0x2E, ".").when((code == 0x5F) | code.between(0x41, 0x5A), letter)
    return F.when(F.substring(text, 3, 14) == "0" * 14, kind)


def encode_missing(kind: Column) -> Column:
    """Bytes of a missing kind; null for anything else."""
    tail = F.substring(kind, 2, 1)
    valid = kind.rlike(r"\A\.[A-Z_]?\z")
    return F.when(valid, F.unhex(F.concat(F.when(tail == "", "2E").otherwise(F.hex(F.ascii(tail).cast("long"))), F.lit("0" * 14))))


def is_missing(raw: Column) -> Column:
    return missing_kind(raw).isNotNull()


def ibm_decode(raw: Column) -> Column:
    """Double of 8 bytes (fewer are filled with zeros); null where missing."""
    text = F.rpad(F.hex(raw), 16, "0")
    lead = F.conv(F.substring(text, 1, 2), 16, 10).cast("int")
    whole = F.conv(F.substring(text, 3, 14), 16, 10).cast("long")
    cut = lambda step: whole - F.pmod(whole, F.lit(step))
    exact = F.when(whole >= 1 << 55, cut(8)).when(whole >= 1 << 54, cut(4)).when(whole >= 1 << 53, cut(2)).otherwise(whole)
    power = F.when(lead >= 128, lead - 128).otherwise(lead) - 78
    # two steps, so that no factor leaves the range of doubles
    value = exact.cast("double") * F.pow(F.lit(16.0), power)
    return F.when(is_missing(F.unhex(text)), F.lit(None)).when(whole == 0, 0.0).when(lead >= 128, -value).otherwise(value)
