"""Fixed-width text: bytes in and out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.model import TransportError

STRICT, LOSSY, LATIN1 = "strict", "lossy", "latin1"
# Characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def decode_text(raw: bytes, mode: str = LOSSY, keep_blanks: bool = False, fail: bool = False) -> str | None:
    """A stored field as text; blank is None. Strict decoding falls back to lossy unless ``fail``."""
    if mode == LATIN1:
        text = raw.decode("latin-1")
    elif mode == STRICT and fail:
        text = raw.decode("utf-8")
    else:
        text = raw.decode("utf-8", "replace")
    return (text if keep_blanks else text.rstrip(WHITE_SPACE)) or None


def fit_bytes(raw: bytes, width: int) -> bytes:
    """Cut or fill with blanks to ``width`` bytes."""
    return raw[:width].ljust(width)


def encode_text(text: str, ascii_only: bool = False) -> bytes:
    """UTF-8; with ``ascii_only``, other characters are an error."""
    if ascii_only and not text.isascii():
        raise TransportError(f"non-ASCII text: {text!r}")
    return text.encode()


def cut_text(text: str, most: int) -> str:
    """At most ``most`` bytes, and no broken character."""
    return text.encode()[:most].decode("utf-8", "ignore")


def pad_text(text: Column, width: int) -> Column:
    """Binary(width): UTF-8 bytes, cut or filled with blanks; null is blank."""
    raw = F.coalesce(F.encode(text.cast("string"), "UTF-8"), F.lit(b""))
    return F.rpad(F.substring(raw, 1, width), width, F.lit(b" "))


def truncate_text(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` bytes that breaks no character."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    hexed = F.hex(raw)
    # a lead byte and fewer continuation bytes than it asks for, at the end
    broken = F.length(F.regexp_extract(hexed, r"(?:..)*?((?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2}))\z", 1)) / 2
    whole = F.octet_length(text) <= most
    return F.when(whole, text).otherwise(F.decode(F.unhex(F.substring(hexed, F.lit(1), (F.length(hexed) - 2 * broken).cast("int"))), "UTF-8"))


def is_printable(text: Column) -> Column:
    return text.rlike(r"\A[\x20-\x7E]*\z")


def is_ascii(text: Column) -> Column:
    return text.rlike(r"\A[\x00-\x7F]*\z")


def text_of_bytes(raw: Column) -> Column:
    """UTF-8 with U+FFFD for what isn't."""
    return F.make_valid_utf8(raw.cast("string"))


def hex_of_bytes(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.rtrim(text), F.lit(""))
