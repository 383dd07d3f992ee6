"""File sizes and how many rows fit."""

from __future__ import annotations

from tidewater.model import Plan

RECORD, DESCRIPTOR = 80, 140
GIB = 1024**3
#: Records beside the descriptors: library 3, member 4, descriptors' header 1, observations' header 1.
FIXED_RECORDS = 9
COMPAT_RECORDS = 8  # one member record is not counted


def up(n: int) -> int:
    """To whole records."""
    return -(-n // RECORD) * RECORD


def overhead(plan: Plan, compat: bool = False) -> int:
    return (COMPAT_RECORDS if compat else FIXED_RECORDS) * RECORD + up(len(plan.variables) * DESCRIPTOR)


def file_size(plan: Plan, rows: int, compat: bool = False) -> int:
    """Bytes of the file; with ``compat``, the estimate that is a record short."""
    return overhead(plan, compat) + up(rows * plan.row_bytes)


def file_size_gib(plan: Plan, rows: int, compat: bool = False) -> float:
    return file_size(plan, rows, compat) / GIB


def rows_that_fit(plan: Plan, most: int, compat: bool = False) -> int | None:
    """None if not even the headers fit. A table without columns has no bound: 2^63 - 1.

    Exactly: the last record is filled up, so only whole records count; ``compat`` leaves that out.
    """
    room = most - overhead(plan, compat)
    if room <= 0:
        return None
    if plan.row_bytes == 0:
        return 2**63 - 1
    return (room if compat else room // RECORD * RECORD) // plan.row_bytes


def part_path(path: str, number: int) -> str:
    """``out.xpt`` and 1: ``out_001.xpt``."""
    folder, slash, name = path.rpartition("/")
    stem, dot, ending = name.rpartition(".")
    if not dot:
        stem, ending = name, "xpt"
    return f"{folder}{slash}{stem}_{number:03d}.{ending}"
