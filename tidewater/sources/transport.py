"""Spark data source ``transport``: transport files in parallel, both ways.

Reading: the driver parses headers (schema, one partition for each run of rows); tasks read their byte ranges and
hand Spark Arrow batches made by numpy, only for the columns asked for (option ``columns``) and, with option
``pushFilters`` (and Spark's ``spark.sql.python.filterPushdown.enabled``), only for the rows that simple filters keep.
Where further members start is searched here for files up to ``SEARCH`` bytes; for larger ones ``tidewater.operators.tables`` has tasks
search and passes the places on (option ``places``).
Writing: tasks encode their rows to part files beside the target, once. On commit the parts are put together in partition order; with option
``staging`` they stay there with a manifest, and ``tidewater.operators.tables`` cuts them into files in tasks.
Paths are ones that driver and executors reach alike (``tidewater.sources.storage``). Timestamps with a zone are written as the session's local time.

Options to read: member, columns, textMode (lossy, strict, latin1), preserveBlanks, blankRows (trailing, stop), rowLimit,
mode (PERMISSIVE, FAILFAST), specialMissing, bareFormats, rowsPerPartition, rowId, fileId, pushFilters.
Of many files, the driver reads the headers of the first and of those over ``SHARE`` bytes only; smaller ones go to tasks whole, several to each.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from tidewater.functions.ibm import decode_array, encode_array
from tidewater.functions.text import LATIN1, LOSSY, STRICT, WHITE_SPACE
from tidewater.model import CorruptError, MemberNotFoundError, Plan, SchemaError
from tidewater.plans.planner import describe
from tidewater.plans.sizes import up
from tidewater.sources import storage
from tidewater.sources.headers import Catalogue, Member, header_bytes, member_places, parse_catalogue

ROWS = 1 << 17  # of a partition, by default about 16 MB of rows at 128 bytes
BATCH = 1 << 14
SEARCH = 64 << 20
SHARE = 4 << 20  # of small files that one task reads
MANIFEST = "manifest.json"


def inspect_file(path: str, bare_formats: bool = False, places: list[int] | None = None) -> Catalogue:
    """Members and layouts. ``places`` are those of the member headers; without them the file is searched from its first rows on."""
    total = storage.size(path)
    if not total:
        raise CorruptError("empty file")

    def find(at: int) -> int:
        if places is not None:
            return next((p for p in places if p >= at), -1)
        return next(member_places(storage.chunks(path, at, total), at), -1)

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    with storage.open_input(path) as f:
        return parse_catalogue(read, total, find, bare_formats)


def field_of(v) -> T.StructField:
    about = describe(v.name, label=v.label or None, format=v.format, informat=v.informat, length=None if v.numeric else v.length)
    return T.StructField(v.name, T.DoubleType() if v.numeric else T.StringType(), True, about)


@dataclass
class Rows:
    """A run of rows of one file, laid out as the reader's ``plans[plan]``; or a whole file (``count`` -1), whose headers the task reads."""

    path: str
    file: int  # which of the files
    plan: int = -1
    start: int = 0
    first: int = 0
    count: int = -1


@dataclass
class Share(InputPartition):
    """What one task reads, in this order."""

    runs: list[Rows]


def _truth(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


def _trimmed(column: pa.Array) -> pa.Array:
    return pc.utf8_rtrim(column, WHITE_SPACE)


def _texts(cell: np.ndarray, mode: str, fail: bool) -> pa.Array:
    """Strings of (rows, width) bytes; only rows that aren't valid as they are take a loop."""
    n, width = cell.shape
    offsets = np.arange(0, cell.size + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    make = lambda kind, data: pa.Array.from_buffers(kind, n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    high = (cell >= 128).any(1)
    if not high.any():
        return make(pa.string(), cell)
    if mode != LATIN1:
        try:
            return make(pa.binary(), cell).cast(pa.string())
        except pa.ArrowInvalid:
            if fail and mode == STRICT:
                raise ValueError("rows that UTF-8 can't decode") from None
    form, errors = ("latin-1", "strict") if mode == LATIN1 else ("utf-8", "replace")
    other = pa.array([bytes(x).decode(form, errors) for x in cell[high]], pa.string())
    plain = make(pa.string(), np.where(high[:, None], np.uint8(32), cell))
    return pc.replace_with_mask(plain, pa.array(high), other)


def decode_rows(table: np.ndarray, plan: Plan, wanted: Iterable[str], mode: str = LOSSY, keep_blanks: bool = False, special: bool = False, fail: bool = False) -> dict[str, pa.Array]:
    """Columns of whole rows, which come as (rows, row bytes)."""
    out = {}
    for v in plan.variables:
        if v.name not in wanted:
            continue
        cell = np.ascontiguousarray(table[:, v.position : v.position + v.length])
        if v.numeric:
            full = np.zeros((len(cell), 8), np.uint8)
            full[:, : min(8, v.length)] = cell[:, :8]
            value, missing, first = decode_array(full)
            out[v.name] = pa.array(value, pa.float64(), mask=missing)
            if special:
                names = np.array(["." if b == 0x2E else f".{chr(b)}" for b in range(256)], object)
                out[f"{v.name}__missing"] = pa.array(names[first], pa.string(), mask=~missing)
            continue
        column = _texts(cell, mode, fail)
        if not keep_blanks:
            column = _trimmed(column)
        out[v.name] = pc.if_else(pc.equal(column, ""), pa.scalar(None, pa.string()), column)
    return out


def as_rows(raw: bytes, plan: Plan) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(-1, plan.row_bytes)


COMPARISONS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def holds(f: Filter, column: pa.Array) -> pa.Array:
    if isinstance(f, IsNull):
        return column.is_null()
    if isinstance(f, IsNotNull):
        return column.is_valid()
    if isinstance(f, In):
        return pc.and_(column.is_valid(), pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type)))
    return pc.fill_null(COMPARISONS[type(f)](column, pa.scalar(f.value, column.type)), False)


def find_member(path: str, options: dict) -> Member:
    """The member that the options name, or the first."""
    catalogue = inspect_file(path, _truth(options, "bareformats"), json.loads(options.get("places", "{}")).get(path))
    if not catalogue.members:
        raise CorruptError("no members")
    wanted = options.get("member")
    member = catalogue.find(wanted) if wanted else catalogue.members[0]
    if member is None:
        raise MemberNotFoundError(f"member not found: {wanted}")
    return member


def rows_to_read(path: str, m: Member, options: dict) -> int:
    n = m.rows
    if options.get("blankrows", "trailing") == "stop":
        stops = json.loads(options.get("stops", "{}"))
        n = stops[path] if path in stops else blank_row(path, m, 0, n)
    if options.get("mode", "").upper() == "FAILFAST" and m.plan.row_bytes:
        rest = (m.end - m.start) - n * m.plan.row_bytes
        if any(raw.strip(b" ") for raw in storage.chunks(path, m.end - rest, m.end)):
            raise CorruptError(f"{path}: the last row is incomplete")
    return n


class TransportReader(DataSourceReader):
    def __init__(self, options: dict, files: list[str], schema: T.StructType):
        self.options, self.files, self.schema = options, files, schema
        self.filters: list[Filter] = []
        whole = len(files) > 1 and not {"rowlimit", "stops", "rowspartition", "rowsperpartition"} & options.keys()
        self.sizes = [storage.size(f) for f in files] if whole else [SHARE + 1] * len(files)
        #: None is left to tasks
        self.members = [find_member(f, options) if not k or n > SHARE else None for k, (f, n) in enumerate(zip(files, self.sizes, strict=True))]
        distinct: dict[bytes, int] = {}
        self.layout = [-1 if m is None else distinct.setdefault(pickle.dumps(m.plan), len(distinct)) for m in self.members]
        self.plans = [pickle.loads(p) for p in distinct]

    def __getstate__(self) -> dict:
        """What tasks need: shares name their files themselves."""
        own = {k: v for k, v in self.__dict__.items() if k not in ("files", "sizes", "members", "layout")}
        return own | {"options": {k: v for k, v in self.options.items() if k not in ("files", "path", "stops")}}

    def partitions(self) -> list[Share]:
        step, left = int(self.options.get("rowspartition", self.options.get("rowsperpartition", ROWS))), int(self.options.get("rowlimit", 2**62))
        found: list[Share] = []
        room = 0
        for k, path in enumerate(self.files):
            if self.sizes[k] <= SHARE:
                if self.sizes[k] > room:
                    found.append(Share([]))
                    room = SHARE
                found[-1].runs.append(Rows(path, k))
                room -= self.sizes[k]
                continue
            m, room = self.members[k], 0
            n = min(rows_to_read(path, m, self.options), left)
            left -= n
            found += [Share([Rows(path, k, self.layout[k], m.start + a * m.plan.row_bytes, a, min(step, n - a))]) for a in range(0, n, step)]
        return found

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of no partition
            return
        for run in partition.runs:
            if run.count < 0:
                m = find_member(run.path, self.options)
                run = Rows(run.path, run.file, -1, m.start, 0, rows_to_read(run.path, m, self.options))
                yield from self._decoded(run, m.plan)
            else:
                yield from self._decoded(run, self.plans[run.plan])

    def _decoded(self, run: Rows, plan: Plan) -> Iterator[pa.RecordBatch]:
        names = self.schema.fieldNames()
        special, keep = _truth(self.options, "specialmissing"), _truth(self.options, "preserveblanks")
        fail = self.options.get("mode", "").upper() == "FAILFAST"
        decode = lambda rows, wanted: decode_rows(rows, plan, wanted, self.options.get("textmode", LOSSY), keep, special, fail)
        with storage.open_input(run.path) as f:
            f.seek(run.start)
            for a in range(0, run.count, BATCH):
                n = min(BATCH, run.count - a)
                raw = f.read(n * plan.row_bytes)
                if len(raw) < n * plan.row_bytes:
                    raise CorruptError(f"{run.path}: ends within its rows")
                rows, ids = as_rows(raw, plan), np.arange(run.first + a, run.first + a + n)
                for own in self.filters:
                    name = own.attribute[0]
                    kept = holds(own, decode(rows, [name])[name]).to_numpy(zero_copy_only=False)
                    rows, ids = rows[kept], ids[kept]
                columns = decode(rows, names)
                columns["_row_id"] = pa.array(ids, pa.int64())
                columns["_file_id"] = pa.array(np.full(len(ids), run.file, np.int32))
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


class FilteringReader(TransportReader):
    """Filters that compare a column of the file with a value are applied to rows before their other columns are decoded."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        own = set.intersection(*({v.name for v in m.plan.variables} for m in self.members if m is not None))
        for f in filters:
            if isinstance(f, (*COMPARISONS, In, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in own:
                self.filters.append(f)
            else:
                yield f


def blank_row(path: str, m: Member, first: int, end: int) -> int:
    """The first blank row from ``first`` up to ``end``, or ``end``."""
    with storage.open_input(path) as f:
        f.seek(m.start + first * m.plan.row_bytes)
        for a in range(first, end, BATCH):
            n = min(BATCH, end - a)
            blank = (np.frombuffer(f.read(n * m.plan.row_bytes), np.uint8).reshape(n, -1) == 32).all(1)
            if blank.any():
                return a + int(blank.argmax())
    return end


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


def fixed_width(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) bytes of texts, cut or filled with blanks; null is blank."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + column.offset + 1)[column.offset :]
    data = column.buffers()[2]
    out = np.full((len(column), width), 32, np.uint8)
    if data is not None and data.size:
        inside = np.arange(width) < np.diff(at)[:, None]
        out[inside] = np.frombuffer(data, np.uint8)[(at[:-1, None] + np.arange(width))[inside]]
    return out


def _binary_text(column: pa.Array) -> pa.Array:
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in column.to_pylist()], pa.string())


def encode_rows(batch: pa.RecordBatch, plan: Plan, zone: str = "UTC") -> np.ndarray:
    """(rows, row bytes) of a batch whose columns are in the table's order."""
    out = np.full((batch.num_rows, plan.row_bytes), 32, np.uint8)
    for v in plan.variables:
        column = batch.column(v.source_index)
        where = slice(v.position, v.position + v.length)
        if pa.types.is_timestamp(column.type):
            if column.type.tz:
                column = pc.local_timestamp(column.cast(pa.timestamp("us", zone)))
            column = column.cast(pa.timestamp("us"))
        if v.numeric:
            kind = column.type
            if pa.types.is_date(kind):
                column = pc.add(column.cast(pa.int32()).cast(pa.float64()), 3653.0)
            elif pa.types.is_timestamp(kind):
                since = pc.add(column.cast(pa.int64()), 3653 * 86_400 * 1_000_000)
                column = pc.divide(since, 1_000_000).cast(pa.float64(), safe=False)  # toward zero
            out[:, where] = encode_array(column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False))
        else:
            if pa.types.is_temporal(column.type):
                column = pc.strftime(column, format="%Y-%m-%d" if pa.types.is_date(column.type) else "%Y-%m-%dT%H:%M:%S")
                column = pc.utf8_slice_codeunits(column, 0, 19)
            elif pa.types.is_binary(column.type):
                column = _binary_text(column)
            out[:, where] = fixed_width(column, v.length)
    return out


def cut(parts: list[Part], most: int) -> list[list[tuple[str, int, int]]]:
    """Files of at most ``most`` rows, in order, each as runs of rows (path, first, number); one file if there is no row."""
    files: list[list[tuple[str, int, int]]] = [[]]
    room = most
    for p in sorted(parts, key=lambda p: p.partition):
        first = 0
        while first < p.rows:
            if not room:
                files.append([])
                room = most
            n = min(room, p.rows - first)
            files[-1].append((p.path, first, n))
            first, room = first + n, room - n
    return files


def assemble(target: str, plan: Plan, stamps: tuple[str, str], runs: list[tuple[str, int, int]]) -> int:
    """Write one file from runs of rows of part files and give the number of rows. It appears whole or not at all."""
    temp, rows = f"{target}.{uuid.uuid4().hex}.tmp", 0
    with storage.create(temp) as out:
        out.write(header_bytes(plan, *stamps))
        for path, first, n in runs:
            begin, got = first * plan.row_bytes, 0
            for raw in storage.chunks(path, begin, begin + n * plan.row_bytes):
                out.write(raw)
                got += len(raw)
            if got < n * plan.row_bytes:
                raise CorruptError(f"{path}: {got} bytes in place of {n} rows")
            rows += n
        filled = rows * plan.row_bytes
        out.write(b" " * (up(filled) - filled))
    storage.move(temp, target)
    return rows


class TransportWriter(DataSourceArrowWriter):
    """Option ``plan`` is the layout, pickled as hex by ``tidewater.operators.tables``."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.plan: Plan = pickle.loads(bytes.fromhex(options["plan"]))
        self.stamps = options.get("created", ""), options.get("modified", "")
        self.zone, self.keep = options.get("zone", "UTC"), "staging" in options
        self.staging = options.get("staging", f"{self.path}.{uuid.uuid4().hex}.parts")
        if not overwrite and storage.exists(self.path):
            raise SchemaError(f"{self.path} exists")
        storage.make_folder(self.staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        path, rows = f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}", 0
        with storage.create(path) as f:
            for batch in iterator:
                f.write(encode_rows(batch, self.plan, self.zone).tobytes())
                rows += batch.num_rows
        return Part(task.partitionId(), path, rows)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m]
        if self.keep:
            with storage.create(f"{self.staging}/{MANIFEST}") as f:
                f.write(json.dumps([(p.partition, p.path, p.rows) for p in parts]).encode())
            return
        assemble(self.path, self.plan, self.stamps, cut(parts, 2**62)[0])
        storage.remove_folder(self.staging)

    def abort(self, messages: list[Part | None]) -> None:
        storage.remove_folder(self.staging)


def staged_parts(staging: str) -> list[Part]:
    with storage.open_input(f"{staging}/{MANIFEST}") as f:
        return [Part(*p) for p in json.loads(f.read())]


class TransportSource(DataSource):
    """``spark.read.format("transport").load(path)``; path may be a pattern, its files being parts of one table."""

    @classmethod
    def name(cls) -> str:
        return "transport"

    def _files(self) -> list[str]:
        return json.loads(self.options["files"]) if "files" in self.options else storage.matching(self.options["path"])

    def schema(self) -> T.StructType:
        member = find_member(self._files()[0], self.options)
        wanted = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else None
        fields = [field_of(v) for v in member.plan.variables if wanted is None or v.name in wanted]
        if wanted:
            fields.sort(key=lambda f: wanted.index(f.name))
        if _truth(self.options, "specialmissing"):
            fields += [T.StructField(f"{f.name}__missing", T.StringType()) for f in fields if f.dataType == T.DoubleType()]
        if _truth(self.options, "rowid"):
            fields.append(T.StructField("_row_id", T.LongType()))
        if _truth(self.options, "fileid"):
            fields.append(T.StructField("_file_id", T.IntegerType()))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> TransportReader:
        kind = FilteringReader if _truth(self.options, "pushfilters") else TransportReader
        return kind(dict(self.options), self._files(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> TransportWriter:
        return TransportWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TransportSource)
