"""Rules that a layout must keep: the format's limits, and three agencies' policies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import is_ascii
from tidewater.model import V5, Issue, Plan

# Limits and name patterns.
NUMERIC_BYTES, TEXT_BYTES, MAX_GIB = 8, 200, 5.0
DATASET_PATTERN = "^[A-Z][A-Z0-9]{0,7}$"
VARIABLE_PATTERN = "^[A-Z_][A-Z0-9_]{0,7}$"


@dataclass(frozen=True)
class Agency:
    """A regulator's policy."""

    name: str
    ascii_labels: bool
    ascii_values: bool
    ascii_names: bool = True
    name_bytes: int = 8
    label_bytes: int = 40
    text_bytes: int = TEXT_BYTES
    max_gib: float = MAX_GIB
    name_is_file_stem: bool = True


FDA, PMDA, NMPA = Agency("FDA", True, True), Agency("PMDA", False, False), Agency("NMPA", False, False)
AGENCIES = {a.name: a for a in (FDA, PMDA, NMPA)}
Check = Callable[[Plan], Iterator[Issue]]


def _bytes(text: str) -> int:
    return len(text.encode())


def _limit(code: str, kind: str | None, name: str | None, most: int, actual: int, **more: object) -> Issue:
    return Issue(code, kind, name, {"max": most, "actual": actual, **more})


def structural(plan: Plan) -> list[Issue]:
    """Limits of version 5, in file order: the dataset, each variable, the row."""
    found = []
    if _bytes(plan.name) > V5.name_bytes:
        found.append(_limit("DatasetNameTooLong", "dataset", plan.name, V5.name_bytes, _bytes(plan.name)))
    if plan.label is None:
        found.append(Issue("MissingDatasetLabel", "dataset", plan.name))
    elif _bytes(plan.label) > V5.label_bytes:
        found.append(_limit("DatasetLabelTooLong", "dataset", plan.name, V5.label_bytes, _bytes(plan.label)))
    for v in plan.variables:
        checks = (
            ("VariableNameTooLong", _bytes(v.name) > V5.name_bytes, V5.name_bytes, _bytes(v.name)),
            ("MissingVariableLabel", not v.label, 0, 0),
            ("VariableLabelTooLong", _bytes(v.label) > V5.label_bytes, V5.label_bytes, _bytes(v.label)),
            ("NumericWrongLength", v.numeric and v.length != NUMERIC_BYTES, NUMERIC_BYTES, v.length),
            ("CharacterLengthTooShort", not v.numeric and v.length < 1, 1, v.length),
            ("CharacterLengthTooLong", not v.numeric and v.length > TEXT_BYTES, TEXT_BYTES, v.length),
        )
        found += [_limit(code, "variable", v.name, most, actual) for code, broken, most, actual in checks if broken]
    total = sum(v.length for v in plan.variables)
    if total != plan.row_bytes:
        found.append(_limit("RowLenInconsistent", None, None, plan.row_bytes, total))
    return found


def _each(plan: Plan) -> list[tuple[str, str, str, str | None]]:
    """(kind, issue's word, name, label) of the dataset and its variables."""
    return [("dataset", "Dataset", plan.name, plan.label), *(("variable", "Variable", v.name, v.label) for v in plan.variables)]


def policy(plan: Plan, agency: Agency, path: str | None = None) -> list[Issue]:
    """An agency's rules, one after the other over the whole plan."""
    names = _each(plan)
    found = [Issue(f"NonAscii{word}Name", kind, name) for kind, word, name, _ in names if not name.isascii()]
    found += [_limit(f"Agency{word}NameTooLong", kind, name, agency.name_bytes, _bytes(name)) for kind, word, name, _ in names if _bytes(name) > agency.name_bytes]
    for kind, _, name, label in names:
        size = _bytes(label or "")
        if size > agency.label_bytes:
            found.append(_limit("AgencyLabelTooLong", kind, name, agency.label_bytes, size))
        elif label and not label.isascii() and size >= agency.label_bytes * 80 // 100:
            found.append(_limit("MultiByteLabelNearLimit", kind, name, agency.label_bytes, size, chars=len(label)))
    found += [_limit("CharacterValueLengthExceeded", "variable", v.name, agency.text_bytes, v.length, agency=agency.name) for v in plan.character_variables if v.length > agency.text_bytes]
    if path is not None and agency.name_is_file_stem:
        stem = path.rpartition("/")[2]
        stem = stem.rpartition(".")[0] or stem
        if stem.lower() != plan.name.lower():
            found.append(Issue("DatasetNameFileStemMismatch", "dataset", plan.name, {"stem": stem}))
    for kind, word, name, _ in names:
        pattern = DATASET_PATTERN if kind == "dataset" else VARIABLE_PATTERN
        if not re.fullmatch(pattern[1:-1], name):
            found.append(Issue(f"{word}NamePatternMismatch", kind, name, {"agency": agency.name, "pattern": pattern}))
    if agency.ascii_labels:
        found += [Issue(f"NonAscii{word}Label", kind, name) for kind, word, name, label in names if label and not label.isascii()]
    return found


def validate(plan: Plan, agency: Agency | None = None, path: str | None = None) -> list[Issue]:
    return structural(plan) + (policy(plan, agency, path) if agency else [])


def issue_frame(spark, issues: list[Issue]) -> DataFrame:
    rows = [(i, x.code, x.severity, x.kind, x.name, x.message, {k: str(v) for k, v in x.details.items()}) for i, x in enumerate(issues)]
    return spark.createDataFrame(rows, "number int, code string, severity string, target_kind string, target string, message string, details map<string,string>")


def non_ascii_values(df: DataFrame) -> DataFrame:
    """(name, n, longest) for each text column: values that are not ASCII, and the longest in bytes. One pass over the data."""
    columns = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    if not columns:
        return df.sparkSession.createDataFrame([], "name string, n long, longest int")
    sums = df.agg(*[x for i, c in enumerate(columns) for x in (F.count_if(~is_ascii(F.col(f"`{c}`"))).alias(f"n{i}"), F.coalesce(F.max(F.octet_length(F.col(f"`{c}`"))), F.lit(0)).alias(f"m{i}"))])
    parts = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("longest")) for i, c in enumerate(columns)])
    return sums.select(F.inline(parts))
