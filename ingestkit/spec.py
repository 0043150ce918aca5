"""Typed, validated views of a task description (a plain mapping, for example loaded from YAML)."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from ingestkit.functions.cleaning import sql_type
from ingestkit.functions.datetimes import run_time, strftime

_SPARK_TYPES = {"bigint": LongType(), "double": DoubleType(), "string": StringType(), "timestamp": TimestampType()}
_DEFAULT = re.compile(r"\bDEFAULT\s+(\((?:[^()]|\([^()]*\))*\)|'(?:[^']|'')*'|[^\s,]+)", re.IGNORECASE)
_UNIQUE, _QUOTED = re.compile(r"\b(UNIQUE|PRIMARY\s+KEY)\b"), re.compile(r"'(?:[^']|'')*'")
_NOW = re.compile(r"(datetime|date|time)\s*\(\s*'now'", re.IGNORECASE)
_STRFTIME = re.compile(r"strftime\s*\(\s*'([^']*)'\s*,\s*'now'", re.IGNORECASE)
_CLOCKS = {"datetime": "%Y-%m-%d %H:%M:%S", "date": "%Y-%m-%d", "time": "%H:%M:%S"}


class SpecError(ValueError):
    """A task description that cannot be run as written."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    sql: str                 # Spark type name
    not_null: bool = False
    default: str | None = None
    auto_id: bool = False
    unique: bool = False

    @classmethod
    def from_dict(cls, d: Mapping) -> ColumnSpec:
        text = " ".join(str(d[k]) for k in ("type", "constraint") if d.get(k))
        upper = text.upper()
        found = _DEFAULT.search(text)
        return cls(d["name"], sql_type(d.get("type")), "NOT NULL" in upper,
                   found.group(1) if found else None, "PRIMARY KEY" in upper and "AUTOINCREMENT" in upper,
                   bool(_UNIQUE.search(_QUOTED.sub("", upper))))

    def default_column(self, run_ts) -> Column | None:
        """The default for inserted rows; time functions use the one run time."""
        if self.default is None:
            return None
        text = self.default.strip()
        named, clock = _STRFTIME.search(text), _NOW.search(text)
        if named:
            value = strftime(run_time(run_ts), named.group(1))
        elif clock:
            value = strftime(run_time(run_ts), _CLOCKS[clock.group(1).lower()])
        else:
            bare = text.strip("()").strip()
            if bare.upper() == "NULL":
                return None
            value = F.lit(bare[1:-1].replace("''", "'") if bare.startswith("'") else bare)
        return value.cast(self.sql)


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...] = ()
    keys: tuple[str, ...] = ()                  # the first unique key
    unique: tuple[tuple[str, ...], ...] = ()    # all of them

    @classmethod
    def from_dict(cls, name: str, schema: Mapping) -> TableSpec:
        declared = [ColumnSpec.from_dict(c) for c in schema.get("columns") or ()]
        # the business key identifies rows, so there is no counter column
        columns = tuple(c for c in declared if not c.auto_id)
        unique = [tuple(i["columns"]) for i in schema.get("indexes") or () if i.get("unique")]
        unique += [(c.name,) for c in columns if c.unique]
        unique = list({frozenset(k): k for k in reversed(unique)}.values())[::-1]
        unknown = [c for k in unique for c in k if c not in {c.name for c in columns}]
        if unknown:
            raise SpecError(f"table {name}: key columns {unknown} are not declared")
        return cls(name, columns, unique[0] if unique else (), tuple(unique))

    @property
    def schema(self) -> StructType:
        return StructType([StructField(c.name, _SPARK_TYPES[c.sql]) for c in self.columns])

    def type_of(self, column: str) -> str:
        for c in self.columns:
            if c.name == column:
                return c.sql
        return "string"

    def defaults(self, run_ts, supplied=()) -> dict[str, Column]:
        found = {c.name: c.default_column(run_ts) for c in self.columns if c.name not in supplied}
        return {k: v for k, v in found.items() if v is not None}

    def not_null(self) -> list[str]:
        return [c.name for c in self.columns if c.not_null]


@dataclass(frozen=True)
class OutputSpec:
    table: TableSpec
    parser: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: Mapping) -> OutputSpec:
        if not d.get("target_table"):
            raise SpecError("output without target_table")
        table = TableSpec.from_dict(d["target_table"], d.get("table_schema") or {})
        parser = d.get("parser") or {}
        names = [f.get("name") for f in parser.get("fields") or ()]
        if None in names or len(set(names)) != len(names):
            raise SpecError(f"output {table.name}: field names must be present and distinct")
        if table.columns:
            loose = [n for n in names if n not in {c.name for c in table.columns}]
            if loose:
                raise SpecError(f"output {table.name}: fields {loose} are not table columns")
        return cls(table, parser)

    @property
    def fields(self) -> list[dict]:
        """Field configs, each with the declared type of its column (text where none is declared)."""
        names = {"bigint": "INTEGER", "double": "REAL", "string": "TEXT", "timestamp": "TIMESTAMP"}
        return [{"type": names[self.table.type_of(f["name"])], **f} for f in self.parser.get("fields") or ()]


@dataclass(frozen=True)
class TaskSpec:
    name: str
    type: str = "web"
    url: str = ""
    params: Mapping[str, Any] = field(default_factory=dict)
    iterate: Any = None
    outputs: tuple[OutputSpec, ...] = ()
    source: Mapping[str, Any] = field(default_factory=dict)
    enabled: bool = True

    @classmethod
    def from_dict(cls, d: Mapping) -> TaskSpec:
        if not d.get("name"):
            raise SpecError("task without name")
        outputs = d.get("outputs")
        if not outputs and d.get("target_table"):
            outputs = [d]  # a single output may be written at the top level
        if not outputs:
            raise SpecError(f"task {d['name']}: no outputs")
        kind = d.get("type", "web")
        return cls(d["name"], kind, d.get("url", ""), d.get("params") or {}, d.get("iterate"),
                   tuple(OutputSpec.from_dict(o) for o in outputs),
                   d.get("file") or d.get("db") or {}, d.get("enabled", True))


def load_task(path: str) -> TaskSpec:
    """A task description from a YAML file (needs the optional ``yaml`` package)."""
    try:
        import yaml
    except ImportError as e:
        raise SpecError("reading YAML needs the yaml package; TaskSpec.from_dict takes a mapping") from e
    with open(path, encoding="utf-8") as f:
        return TaskSpec.from_dict(yaml.safe_load(f))
