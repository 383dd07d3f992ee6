"""Formats, variables, plans, issues and errors of transport files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


class TransportError(Exception):
    """Base of this library's errors."""


class CorruptError(TransportError):
    """The bytes are no transport file."""


class SchemaError(TransportError):
    """A table can't be laid out as asked."""


class ValidationError(TransportError):
    """A plan breaks rules, and strict checks are on."""


class MemberNotFoundError(TransportError):
    """No member has that name."""


class ColumnLengthError(TransportError):
    """Columns of unequal length."""


class UnsupportedVersionError(TransportError):
    """Only version 5 is read and written."""


class FormatError(TransportError, ValueError):
    """A display format can't be parsed."""


class CatalogueError(TransportError):
    """A standards folder can't be loaded."""


class MissingFileError(CatalogueError):
    """A file of a standards folder is absent."""


class UnknownStandardError(CatalogueError):
    """The manifest names no known publishing set."""


@dataclass(frozen=True, order=True)
class Version:
    """File format version and its limits in bytes."""

    number: int
    name_bytes: int
    label_bytes: int

    @property
    def implemented(self) -> bool:
        return self.number == 5


V5, V8 = Version(5, 8, 40), Version(8, 32, 256)

ROLES = ("Identifier", "Topic", "Timing", "Qualifier", "Rule")
LEFT, RIGHT = 0, 1
U16 = 65535


@dataclass(frozen=True)
class Format:
    """A display format such as ``DATE9.``, ``$CHAR20.`` or ``8.2``."""

    name: str = ""
    width: int = 8
    decimals: int = 0
    justification: int = RIGHT

    @property
    def is_character(self) -> bool:
        return self.name.startswith("$") or self.name.upper() == "CHAR"

    @property
    def bare_name(self) -> str:
        """The name without ``$``, as descriptors hold it."""
        return self.name.removeprefix("$")

    @classmethod
    def numeric(cls, width: int, decimals: int = 0) -> Format:
        return cls("", width, decimals)

    @classmethod
    def character(cls, width: int) -> Format:
        return cls("$CHAR", width, 0, LEFT)

    @classmethod
    def from_descriptor(cls, name: str, width: int, decimals: int, justification: int = 0) -> Format:
        return cls(name, max(0, width), max(0, decimals), LEFT if justification == 0 else RIGHT)

    @classmethod
    def parse(cls, text: str) -> Format:
        text = text.strip()
        m = re.fullmatch(r"(?s)(\$?)(.*?)([0-9]*)\.([^.]*)", text)
        if not text:
            raise FormatError("empty format string")
        if not m:
            raise FormatError(f"{text}: format must contain a '.' separator")
        dollar, name, width, decimals = m.groups()
        if not width:
            raise FormatError(f"{text}: missing width")
        if int(width) > U16:
            raise FormatError(f"{text}: invalid width")
        if decimals and not (re.fullmatch(r"\+?[0-9]+", decimals) and int(decimals) <= U16):
            raise FormatError(f"{text}: invalid decimals")
        return cls(dollar + name.upper(), int(width), int(decimals or 0), LEFT if dollar else RIGHT)

    def with_justification(self, justification: int) -> Format:
        return replace(self, justification=justification)

    def __str__(self) -> str:
        return f"{self.name}{self.width}.{self.decimals or ''}"


@dataclass(frozen=True)
class Variable:
    """A planned or stored column."""

    name: str
    numeric: bool
    length: int
    label: str = ""
    format: Format | None = None
    informat: Format | None = None
    role: str | None = None
    position: int = 0
    source_index: int = 0


@dataclass(frozen=True)
class VariableMetadata:
    """What is known about a column from outside; None leaves the table's own."""

    name: str
    numeric: bool | None = None
    length: int | None = None
    label: str | None = None
    format: str | None = None
    order: int | None = None
    role: str | None = None


@dataclass(frozen=True)
class Plan:
    """Byte layout of a table."""

    name: str
    label: str | None
    variables: tuple[Variable, ...]
    row_bytes: int = 0

    def laid_out(self) -> Plan:
        """Positions one after the other, and the row's length."""
        at, placed = 0, []
        for v in self.variables:
            placed.append(replace(v, position=at))
            at += v.length
        return replace(self, variables=tuple(placed), row_bytes=at)

    @property
    def numeric_variables(self) -> list[Variable]:
        return [v for v in self.variables if v.numeric]

    @property
    def character_variables(self) -> list[Variable]:
        return [v for v in self.variables if not v.numeric]


INFO, WARN, ERROR = "INFO", "WARN", "ERROR"
SEVERITIES = (INFO, WARN, ERROR)  # ascending
WARNINGS = {"CharacterValueLengthExceeded", "MultiByteLabelNearLimit", "MissingVariableLabel", "MissingDatasetLabel"}

# The wording of each issue.
MESSAGES = {
    "DatasetNameTooLong": "dataset name '{name}' exceeds {max} bytes (has {actual} bytes)",
    "AgencyDatasetNameTooLong": "dataset name '{name}' exceeds {max} bytes (has {actual} bytes)",
    "VariableNameTooLong": "variable name '{name}' exceeds {max} bytes (has {actual} bytes)",
    "AgencyVariableNameTooLong": "variable name '{name}' exceeds {max} bytes (has {actual} bytes)",
    "DatasetLabelTooLong": "dataset label exceeds {max} bytes (has {actual} bytes)",
    "VariableLabelTooLong": "variable label exceeds {max} bytes (has {actual} bytes)",
    "NumericWrongLength": "numeric variable '{name}' must have length {max} (has {actual})",
    "CharacterLengthTooShort": "character variable '{name}' must have length >= {max} (has {actual})",
    "CharacterLengthTooLong": "character variable '{name}' must have length <= {max} (has {actual})",
    "RowLenInconsistent": "row_len inconsistency: recorded {max} but computed {actual}",
    "DatasetNamePatternMismatch": "dataset name '{name}' does not match {agency} required pattern '{pattern}'",
    "VariableNamePatternMismatch": "variable name '{name}' does not match {agency} required pattern '{pattern}'",
    "DatasetNameFileStemMismatch": "dataset name '{name}' does not match file stem '{stem}'",
    "NonAsciiDatasetName": "dataset name '{name}' contains non-ASCII characters",
    "NonAsciiVariableName": "variable name '{name}' contains non-ASCII characters",
    "NonAsciiDatasetLabel": "dataset label contains non-ASCII characters",
    "NonAsciiVariableLabel": "variable '{name}' label contains non-ASCII characters",
    "AgencyLabelTooLong": "{kind} '{name}' label exceeds {max} bytes (has {actual} bytes)",
    "CharacterValueLengthExceeded": "character variable '{name}' length {actual} exceeds {agency} policy limit of {max} bytes",
    "MultiByteLabelNearLimit": "{kind} '{name}' label uses {actual} of {max} bytes ({chars} characters) - approaching limit with multi-byte characters",
    "MissingVariableLabel": "variable '{name}' is missing a label (recommended for FDA submissions)",
    "MissingDatasetLabel": "dataset '{name}' is missing a label (recommended for FDA submissions)",
    "InvalidFormatSyntax": "variable '{name}' has invalid format '{format}': {reason}",
}


@dataclass(frozen=True)
class Issue:
    """One finding: its code, what it is about (``dataset``, ``variable`` or None) and details."""

    code: str
    kind: str | None = None
    name: str | None = None
    details: dict = field(default_factory=dict, hash=False)

    @property
    def severity(self) -> str:
        return WARN if self.code in WARNINGS else ERROR

    @property
    def message(self) -> str:
        return MESSAGES[self.code].format(**{"name": self.name, "kind": self.kind, **self.details})

    def __str__(self) -> str:
        return f"[{self.severity}] {self.message}" + (f" ({self.kind}: {self.name})" if self.kind else "")


def errors(issues: list[Issue]) -> list[Issue]:
    return [i for i in issues if i.severity == ERROR]


def warnings(issues: list[Issue]) -> list[Issue]:
    return [i for i in issues if i.severity == WARN]
