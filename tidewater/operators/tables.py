"""Tables of transport files: read, write, split, inspect."""

from __future__ import annotations

import datetime as dt
import json
import os
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.dates import header_stamp
from tidewater.model import V5, ColumnLengthError, CorruptError, Issue, MemberNotFoundError, Plan, SchemaError, UnsupportedVersionError, ValidationError, VariableMetadata, Version, errors, warnings
from tidewater.operators.scratch import scratch
from tidewater.plans.planner import NUMERIC, plan_table
from tidewater.plans.rules import Agency, issue_frame, validate
from tidewater.plans.sizes import GIB, RECORD, file_size, part_path, rows_that_fit
from tidewater.sources import storage
from tidewater.sources.headers import Catalogue, Member, member_places
from tidewater.sources.transport import SEARCH, Part, assemble, blank_row, cut, inspect_file, register, staged_parts

TASKS = 10_000
SMALL = 64 << 20  # bytes of rows that the driver puts together itself, where there is one file


@dataclass(frozen=True)
class TransportTable:
    """A DataFrame with a dataset's name and label."""

    df: DataFrame
    name: str
    label: str | None = None

    def column(self, name: str):
        """The column of exactly that name, or None."""
        return self.df[f"`{name}`"] if name in self.df.columns else None

    def __getitem__(self, key: int | str):
        found = self.column(self.df.columns[key] if isinstance(key, int) else key)
        if found is None:
            raise KeyError(key)
        return found

    def __iter__(self):
        return iter(self.df.schema)

    def __len__(self) -> int:
        return len(self.df.columns)

    def names(self) -> list[str]:
        return self.df.columns

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def extend(self, **columns) -> TransportTable:
        return TransportTable(self.df.withColumns(columns), self.name, self.label)

    def append(self, other: TransportTable) -> TransportTable:
        """Rows of both, by position; names and metadata are this table's."""
        if len(self) != len(other):
            raise ColumnLengthError(f"{len(self)} and {len(other)} columns")
        mine, theirs = ([isinstance(f.dataType, NUMERIC) for f in t.df.schema] for t in (self, other))
        if mine != theirs:
            raise SchemaError("column types differ")
        return TransportTable(self.df.union(other.df), self.name, self.label)

    def rows(self, start: int, end: int, by: str = "_row_id") -> TransportTable:
        """Rows start to end (exclusive) of a table read with ``rowId``."""
        return TransportTable(self.df.where((F.col(by) >= start) & (F.col(by) < end)), self.name, self.label)

    def describe_column(self, name: str) -> str:
        """``AESEQ (Numeric)``."""
        return f"{name} ({'Numeric' if isinstance(self.df.schema[name].dataType, NUMERIC) else 'Character'})"

    def describe(self) -> str:
        return f"{self.name} [{self.count()} rows × {len(self)} cols]"


def _in_ranges(spark: SparkSession, ranges: list[tuple[int, int, int]], f: Callable[[int, int, int], Iterable[int]]) -> list[tuple[int, int]]:
    """(file, place) of all that ``f`` finds in ranges (file, first, end), one task for each."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(ranges[i][0], place) for i in batch.column(0).to_pylist() for place in f(*ranges[i])]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], ["file", "place"])

    rows = spark.range(0, len(ranges), 1, min(len(ranges), TASKS)).mapInArrow(found, "file long, place long")
    return sorted((r[0], r[1]) for r in rows.collect())


def find_members(spark: SparkSession, files: list[str]) -> dict[str, list[int]]:
    """Where members start in the files over ``SEARCH`` bytes, which tasks search in ranges of that size."""
    big = [(f, n) for f in files if (n := storage.size(f)) > SEARCH]
    if not big:
        return {}
    step = SEARCH // RECORD * RECORD
    ranges = [(i, a, min(n, a + step)) for i, (_, n) in enumerate(big) for a in range(0, n, step)]
    hits = _in_ranges(spark, ranges, lambda i, a, b: member_places(storage.chunks(big[i][0], a, b), a))
    places: dict[str, list[int]] = {f: [] for f, _ in big}
    for i, place in hits:
        places[big[i][0]].append(place)
    return places


def _blank_rows(spark: SparkSession, files: list[str], members: list[Member]) -> dict[str, int]:
    """The first blank row of each file's member, or its number of rows, found by tasks."""
    step = max(1, SEARCH // max(1, max(m.plan.row_bytes for m in members)))
    ranges = [(i, a, min(m.rows, a + step)) for i, m in enumerate(members) for a in range(0, m.rows, step)]
    if not ranges:
        return dict.fromkeys(files, 0)
    hits = _in_ranges(spark, ranges, lambda i, a, b: [x for x in [blank_row(files[i], members[i], a, b)] if x < b])
    return {f: next((x for k, x in hits if k == i), m.rows) for i, (f, m) in enumerate(zip(files, members, strict=True))}


def read(spark: SparkSession, path: str | list[str], **options: object) -> TransportTable:
    """The first member, or the one named by ``member``; path may be a pattern for the parts of one table, or a list of them.

    However many files there are, they are one scan; option ``fileId`` gives each row the place of its file among them (``_file_id``, from 0).
    The driver reads headers only; what needs a look at the rows (further members of large files, blank rows that end a table) is left to tasks.
    """
    register(spark)
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    files = storage.matching(path) if isinstance(path, str) else list(path)
    places = find_members(spark, files)
    bare = options.get("bareFormats") == "true"
    stop = options.get("blankRows") == "stop"
    members = []
    for file in files if stop else files[:1]:
        catalogue = inspect_file(file, bare, places.get(file))
        if not catalogue.members:
            raise CorruptError("no members")
        members.append(catalogue.find(str(options["member"])) if "member" in options else catalogue.members[0])
        if members[-1] is None:
            raise MemberNotFoundError(f"member not found: {options['member']}")
    if places:
        options["places"] = json.dumps(places)
    if stop:
        options["stops"] = json.dumps(_blank_rows(spark, files, members))
    if not isinstance(path, str):
        options["files"] = json.dumps(files)
    reader = spark.read.format("transport").options(**options)
    return TransportTable(reader.load(path if isinstance(path, str) else files[0]), members[0].plan.name, members[0].plan.label)


def read_all(spark: SparkSession, path: str, **options: object) -> list[TransportTable]:
    return [read(spark, path, **{**options, "member": name}) for name in inspect(path).names()]


def inspect(path: str) -> Catalogue:
    """Members and layouts; tasks search large files for members where there is a session."""
    spark = SparkSession.getActiveSession()
    return inspect_file(path, places=find_members(spark, [path]).get(path) if spark else None)


def member_frame(spark: SparkSession, catalogue: Catalogue) -> DataFrame:
    rows = [(m.plan.name, m.plan.label, len(m.plan.variables), m.plan.row_bytes, m.rows, m.start) for m in catalogue.members]
    return spark.createDataFrame(rows, "name string, label string, n_variables int, row_bytes int, n_rows long, first_byte long")


@dataclass(frozen=True)
class ValidatedWrite:
    """A plan that passed, ready to be written."""

    table: TransportTable
    plan: Plan
    issues: list[Issue]
    max_bytes: int | None
    created: str
    modified: str
    order_by: list[str] = field(default_factory=list)

    def has_errors(self) -> bool:
        return bool(errors(self.issues))

    def has_warnings(self) -> bool:
        return bool(warnings(self.issues))

    def issue_frame(self) -> DataFrame:
        return issue_frame(self.table.df.sparkSession, self.issues)

    def _parts(self, path: str) -> tuple[str, list[Part]]:
        """Encode the table's rows, once, to part files beside ``path``: their folder, and what is in it."""
        spark = self.table.df.sparkSession
        register(spark)
        staging, seen = f"{path}.{uuid.uuid4().hex}.parts", Observation()
        df = self.table.df.orderBy(*self.order_by) if self.order_by else self.table.df
        rows = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("transport").mode("overwrite")
        rows.options(path=path, staging=staging, plan=pickle.dumps(self.plan).hex(), created=self.created, modified=self.modified, zone=spark.conf.get("spark.sql.session.timeZone")).save()
        parts = staged_parts(staging)
        if sum(p.rows for p in parts) != seen.get["rows"]:
            storage.remove_folder(staging)
            raise CorruptError(f"{seen.get['rows']} rows came, {sum(p.rows for p in parts)} were encoded")
        return staging, parts

    def write_path(self, path: str) -> list[str]:
        """One file, or ``_001``, ``_002`` and so on, each within the size limit.

        Rows go in the order of ``order_by`` if given, else in that of the DataFrame's partitions. They are computed and encoded once; the encoded parts are
        then cut between rows, whatever the partitions were, and every file is put together by a task of its own.
        """
        most = 2**62 if self.max_bytes is None else rows_that_fit(self.plan, self.max_bytes)
        staging, parts = self._parts(path)
        try:
            rows = sum(p.rows for p in parts)
            if self.max_bytes is None or file_size(self.plan, rows) <= self.max_bytes:
                most = max(1, rows)
            if not most:
                raise SchemaError("not even one row fits the size limit")
            files = cut(parts, most)
            paths = [path] if most >= rows else [part_path(path, k + 1) for k in range(len(files))]
            plan, stamps = self.plan, (self.created, self.modified)
            if len(files) == 1 and rows * plan.row_bytes <= SMALL:
                made = assemble(path, plan, stamps, files[0])
            else:
                spark = self.table.df.sparkSession
                shared = spark.sparkContext.broadcast((paths, files))

                def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        n = [assemble(shared.value[0][k], plan, stamps, shared.value[1][k]) for k in batch.column(0).to_pylist()]
                        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

                tasks = max(4 * spark.sparkContext.defaultParallelism, rows * plan.row_bytes // SMALL)
                made = spark.range(0, len(files), 1, min(len(files), tasks, TASKS)).mapInArrow(put_together, "n long").agg(F.sum("n")).first()[0]
                shared.destroy()
            if made != rows:
                raise CorruptError(f"{made} of {rows} rows are in the files")
            return paths
        finally:
            storage.remove_folder(staging)

    def to_bytes(self) -> bytes:
        """The whole file; never split, so for small tables."""
        folder = scratch(self.table.df.sparkSession, "bytes")
        try:
            whole = ValidatedWrite(self.table, self.plan, self.issues, None, self.created, self.modified, self.order_by)
            (path,) = whole.write_path(f"{folder}/one.xpt")
            with storage.open_input(path) as f:
                return f.read()
        finally:
            storage.remove_folder(folder)


@dataclass
class Writer:
    """Collects what to write and how."""

    table: TransportTable
    variables: list[VariableMetadata] | None = None
    policy: Agency | None = None
    version: Version = V5
    limit_gib: float | None = None
    strict: bool = True
    fix_names: bool = False
    created: dt.datetime | None = None
    modified: dt.datetime | None = None
    order_by: list[str] = field(default_factory=list)

    def agency(self, policy: Agency) -> Writer:
        self.policy = policy
        return self

    def xpt_version(self, version: Version) -> Writer:
        self.version = version
        return self

    def max_file_size_gb(self, limit: float) -> Writer:
        self.limit_gib = limit
        return self

    def finalize(self, path: str | None = None) -> ValidatedWrite:
        """Plan and check; with ``strict`` any error raises. ``path`` is for the rule on file names."""
        if not self.version.implemented:
            raise UnsupportedVersionError(f"version {self.version.number}")
        limit = self.limit_gib if self.limit_gib is not None else self.policy.max_gib if self.policy else None
        plan = plan_table(self.table.df, self.table.name, self.table.label, self.variables, self.strict, self.fix_names and self.policy is not None)
        issues = validate(plan, self.policy, path)
        if self.strict and errors(issues):
            raise ValidationError("; ".join(map(str, errors(issues))))
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        stamps = [header_stamp(t or now) for t in (self.created, self.modified or self.created)]
        return ValidatedWrite(self.table, plan, issues, None if limit is None else int(limit * GIB), *stamps, self.order_by)


def writer(table: TransportTable, **options: object) -> Writer:
    return Writer(table, **options)


def batch_folder(spark: SparkSession, folder: str) -> dict[str, TransportTable]:
    """Each file of a folder by its stem."""
    names = [f.rpartition("/")[2] for f in storage.matching(f"{folder}/*")]
    return {os.path.splitext(f)[0]: read(spark, f"{folder}/{f}") for f in names if f.lower().endswith(".xpt")}


def read_v8(path: str):
    raise UnsupportedVersionError("version 8")


def write_v8(table: TransportTable, path: str):
    raise UnsupportedVersionError("version 8")
