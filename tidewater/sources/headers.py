"""Headers and descriptors of transport files, as bytes. No Spark here."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from tidewater.functions.text import WHITE_SPACE, fit_bytes
from tidewater.model import CorruptError, Format, Plan, SchemaError, Variable
from tidewater.plans.sizes import DESCRIPTOR, RECORD, up

# Header records and their prefixes.
LIBRARY = b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!000000000000000000000000000000  "
MEMBER = b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!000000000000000001600000000140  "
MEMBER_DATA = b"HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!000000000000000000000000000000  "
DESCRIPTORS = b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!000000"
OBSERVATIONS = b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!000000000000000000000000000000  "
#: type, hash, length, number, name, label, format name width decimals justification, fill, informat name width decimals, position, rest
LAYOUT = struct.Struct(">hhhh8s40s8shhh2x8shhi52x")


@dataclass(frozen=True)
class Member:
    """One table of a file: its layout and where its rows are."""

    plan: Plan
    start: int  # first byte of the rows
    end: int  # first byte after them, padding included
    rows: int
    created: str
    modified: str


@dataclass(frozen=True)
class Catalogue:
    """What a file holds."""

    members: tuple[Member, ...]
    created: str
    modified: str
    library_label: str | None = None

    def names(self) -> list[str]:
        return [m.plan.name for m in self.members]

    def find(self, name: str) -> Member | None:
        return next((m for m in self.members if m.plan.name.lower() == name.lower()), None)


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").rstrip(WHITE_SPACE + "\0")


def pack_variable(v: Variable, number: int) -> bytes:
    if not 0 <= v.length <= 32767 or number > 9999:
        raise SchemaError(f"variable {v.name}: length {v.length} or number {number} doesn't fit a descriptor")
    f, i = v.format, v.informat
    field = lambda text, width: fit_bytes(text.encode(), width)
    return LAYOUT.pack(
        1 if v.numeric else 2, 0, v.length, number, field(v.name, 8), field(v.label, 40),
        field(f.bare_name if f else "", 8), f.width if f else 0, f.decimals if f else 0, f.justification if f else 0,
        field(i.bare_name if i else "", 8), i.width if i else 0, i.decimals if i else 0, v.position,
    )


def unpack_variable(raw: bytes, bare_formats: bool = False) -> Variable:
    """``bare_formats`` restores formats without a name from their width."""
    kind, _, length, number, name, label, form, fl, fd, fj, inform, il, idec, position = LAYOUT.unpack(raw)
    make = lambda text, w, d, j: Format.from_descriptor(text, w, d, j) if text or (bare_formats and (w > 0 or d > 0)) else None
    return Variable(_text(name), kind != 2, length, _text(label), make(_text(form), fl, fd, fj), make(_text(inform), il, idec, 0), None, position, number - 1)


def header_bytes(plan: Plan, created: str, modified: str) -> bytes:
    """Everything before the rows."""
    if len(plan.variables) > 9999:
        raise SchemaError("more than 9999 variables")
    label = (plan.label or "").encode()
    first = b"SAS     SAS     SASLIB  9.4     ".ljust(64) + fit_bytes(created.encode(), 16)
    own = b"SAS     " + fit_bytes(plan.name.encode(), 8) + b"SASDATA 9.4     "
    out = [
        LIBRARY, first, fit_bytes(modified.encode(), 16).ljust(RECORD),
        MEMBER, MEMBER_DATA, own.ljust(64) + fit_bytes(created.encode(), 16), (fit_bytes(modified.encode(), 16).ljust(32) + fit_bytes(label, 40)).ljust(RECORD),
        DESCRIPTORS + b"%04d" % len(plan.variables) + b"0" * 20 + b"  ",
    ]
    block = b"".join(pack_variable(v, k + 1) for k, v in enumerate(plan.variables))
    return b"".join(out) + block.ljust(up(len(block))) + OBSERVATIONS


def member_places(chunks: Iterable[bytes], first: int = 0) -> Iterator[int]:
    """Where member headers stand on record boundaries in bytes that come from ``first`` on, itself such a boundary."""
    rest = b""
    for chunk in chunks:
        raw = rest + chunk
        at = raw.find(MEMBER)
        while at >= 0:
            if (first + at) % RECORD == 0:
                yield first + at
            at = raw.find(MEMBER, at + 1)
        keep = len(raw) % RECORD
        rest, first = raw[len(raw) - keep :], first + len(raw) - keep


def parse_catalogue(read: Callable[[int, int], bytes], size: int, find: Callable[[int], int], bare_formats: bool = False) -> Catalogue:
    """All members. ``read(at, n)`` gives bytes, ``find(at)`` the place of the next member header from ``at`` on, or -1.

    A member ends where the next one's header stands on a record boundary, or with the file.
    """

    def record(at: int, starts: bytes, what: str) -> bytes:
        raw = read(at, RECORD)
        if len(raw) < RECORD or not raw.startswith(starts):
            raise CorruptError(f"missing {what}")
        return raw

    record(0, LIBRARY, "library header")
    created, modified = _text(record(RECORD, b"", "first header record")[64:]), _text(record(2 * RECORD, b"", "second header record")[:16])
    members, at = [], 3 * RECORD
    while at < size and read(at, RECORD) == MEMBER:
        record(at + RECORD, MEMBER_DATA[:27], "member descriptor header")
        one, two = record(at + 2 * RECORD, b"", "member descriptor"), record(at + 3 * RECORD, b"", "member descriptor")
        head = record(at + 4 * RECORD, DESCRIPTORS, "variable header")
        try:
            n = int(head[54:58])
        except ValueError:
            raise CorruptError("invalid variable count") from None
        raw = read(at + 5 * RECORD, n * DESCRIPTOR)
        if len(raw) < n * DESCRIPTOR:
            raise CorruptError("truncated variable descriptors")
        variables = tuple(unpack_variable(raw[k * DESCRIPTOR : (k + 1) * DESCRIPTOR], bare_formats) for k in range(n))
        begin = at + 5 * RECORD + up(n * DESCRIPTOR)
        record(begin, OBSERVATIONS[:54], "observation header")
        begin += RECORD
        end = find(begin)
        end = size if end < 0 else end
        plan = Plan(_text(one[8:16]), _text(two[32:72]) or None, variables, sum(v.length for v in variables))
        rows = 0
        if plan.row_bytes:
            rows = (end - begin) // plan.row_bytes
            # what fills up the last record is no row
            while rows and begin + (rows - 1) * plan.row_bytes > end - RECORD and not read(begin + (rows - 1) * plan.row_bytes, plan.row_bytes).strip(b" "):
                rows -= 1
        members.append(Member(plan, begin, end, rows, _text(one[64:]), _text(two[:16])))
        at = end
    return Catalogue(tuple(members), created, modified)
