"""One output of a task: payloads → rows → fields → cleaned, filtered rows → keyed table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestkit.functions.cleaning import Cleaner
from ingestkit.functions.predicates import Predicates
from ingestkit.operators.fields import FieldChain, context_value, record_value
from ingestkit.operators.html_rows import html_field, html_rows, page_vars
from ingestkit.operators.json_rows import ORDINAL, ROW, json_field, json_rows
from ingestkit.operators.row_filters import RowFilter, filter_rows
from ingestkit.operators.upsert import upsert
from ingestkit.spec import OutputSpec

HTML_TYPES = ("html_table", "html", "css_selector")
RECORD_TYPES = ("sdk_mapping", "records")

RowExtractor = Callable[[DataFrame, Mapping, str], DataFrame]
"""(payloads, parser config, body column) → payload columns, ``_ordinal`` and a struct ``_row``."""


@dataclass
class Toolkit:
    """All that a user may extend: rules, predicates, row and field extractors, payload filters."""

    cleaner: Cleaner = field(default_factory=Cleaner)
    predicates: Predicates = field(default_factory=Predicates)
    row_extractors: dict[str, RowExtractor] = field(default_factory=dict)
    filters: list[tuple[str, RowFilter]] = field(default_factory=list)
    chain: FieldChain = field(default_factory=lambda: FieldChain([_value, _position, _html, _record]))

    def register_rows(self, kind: str, fn: RowExtractor) -> None:
        self.row_extractors[kind] = fn

    def register_table_function(self, kind: str, function) -> None:
        """A Python table function ``(body, names of the fields, …)`` as row extractor. It yields ``_ordinal`` and a struct
        ``_row``; an object of it may keep state over the payloads of a partition."""
        self.row_extractors[kind] = lambda df, cfg, body: df.lateralJoin(function(
            F.col(body).outer(), F.lit(",".join(f.get("source") or f.get("path") or f["name"] for f in cfg.get("fields", ()) if "value" not in f)),
            *[F.lit(v) for v in cfg.get("arguments", ())])).drop(body)

    def register_filter(self, name: str, fn: RowFilter) -> None:
        self.filters.append((name, fn))

    def register_field_first(self, strategy) -> None:
        self.chain.register_first(strategy)

    def register_field_last(self, strategy) -> None:
        self.chain.register_last(strategy)


def _value(f: Mapping, _parser: Mapping, df: DataFrame) -> Column | None:
    return context_value(f, [c for c in df.columns if c not in (ROW, ORDINAL)])


def _position(f: Mapping, parser: Mapping, _df: DataFrame) -> Column | None:
    if not parser.get("array_index_mapping") or parser.get("type") in HTML_TYPES or "value" in f:
        return None
    return json_field(f, positional=True)


def _html(f: Mapping, parser: Mapping, _df: DataFrame) -> Column | None:
    return html_field(f) if parser.get("type") in HTML_TYPES else None


def _record(f: Mapping, parser: Mapping, df: DataFrame) -> Column | None:
    kind = parser.get("type", "json")
    if "value" in f or parser.get("array_index_mapping") or kind in HTML_TYPES:
        return None
    if kind in RECORD_TYPES:
        return record_value(f, df)
    if ROW in df.columns and kind != "json":
        members = df.schema[ROW].dataType.fieldNames()
        name = next((n for n in (f.get("source"), f.get("path")) if n in members), None)
        return F.col(ROW).getField(name) if name else None
    return json_field(f)


@dataclass(frozen=True)
class OutputResult:
    table: DataFrame
    metrics: DataFrame       # one row: inserted, updated, total
    rows: DataFrame          # cleaned rows that passed every predicate, with payload order
    quarantined: DataFrame   # rows with cells that could not be converted, with _errors
    payloads: DataFrame      # payloads with this output's page variables, for later outputs


def extract_rows(payloads: DataFrame, output: OutputSpec, kit: Toolkit, body: str = "body",
                 doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(raw fields with ``_doc`` and ``_ordinal``, payloads with page variables)"""
    parser, fields = dict(output.parser), output.fields
    parser["fields"] = fields
    kind = parser.get("type", "json")
    variables = parser.get("element_selector") or {}
    if variables:
        payloads = page_vars(payloads, variables, body)
    if kind in kit.row_extractors:
        rows = kit.row_extractors[kind](payloads, parser, body)
        rows = filter_rows(rows, [doc], ORDINAL, parser.get("filters"))
    elif kind in RECORD_TYPES:
        rows = payloads if ORDINAL in payloads.columns else payloads.withColumn(ORDINAL, F.monotonically_increasing_id())
        rows = rows if doc in rows.columns else rows.withColumn(doc, F.lit(0))
        rows = filter_rows(rows, [doc], ORDINAL, parser.get("filters"))
    elif kind in HTML_TYPES:
        rows = html_rows(payloads, parser, body)
    else:
        rows = json_rows(payloads, parser, body)
    raw = rows.select(F.col(doc).alias("_doc"), F.col(ORDINAL),
                      *[kit.chain.column(f, parser, rows).alias(f["name"]) for f in fields])
    for name, fn in kit.filters:
        n = (parser.get("filters") or {}).get(name)
        if n and n > 0:
            raw = fn(raw, n)
    return raw, payloads


def run_output(payloads: DataFrame, output: OutputSpec, target: DataFrame, run_ts,
               kit: Toolkit | None = None, on_error: str = "null", body: str = "body",
               doc: str = "doc_id") -> OutputResult:
    """One lazy plan. ``on_error``: ``null`` keeps a row with a bad cell (as NULL), ``quarantine``
    sets such rows aside, ``fail`` stops the job."""
    kit = kit or Toolkit()
    fields = output.fields
    raw, payloads = extract_rows(payloads, output, kit, body, doc)
    cleaned = kit.cleaner.clean(raw, fields, "fail" if on_error == "fail" else "collect", keep=("_doc", ORDINAL))
    if on_error == "fail":
        cleaned = cleaned.withColumn("_errors", F.array().cast("array<string>"))
    bad = F.size("_errors") > 0
    quarantined = cleaned.where(bad) if on_error == "quarantine" else cleaned.where(F.lit(False))
    good = cleaned.where(~bad) if on_error == "quarantine" else cleaned
    rows = kit.predicates.keep(good, fields).drop("_errors")
    names = [f["name"] for f in fields]
    merged = upsert(target, rows, output.table.keys, ("_doc", ORDINAL),
                    output.table.defaults(run_ts, names))
    return OutputResult(merged.table, merged.metrics, rows, quarantined, payloads)


def run_outputs(payloads: DataFrame, outputs: Sequence[OutputSpec], targets: Mapping[str, DataFrame], run_ts,
                kit: Toolkit | None = None, **options) -> dict[str, OutputResult]:
    """Several outputs of one fetch. Page variables of an output are visible to the later ones."""
    results: dict[str, OutputResult] = {}
    tables = dict(targets)
    for output in outputs:
        name = output.table.name
        result = run_output(payloads, output, tables[name], run_ts, kit, **options)
        payloads, tables[name] = result.payloads, result.table
        if name in results:  # two outputs into one table: the later sees the earlier's rows
            earlier = results[name].metrics
            counts = earlier.unionByName(result.metrics).agg(
                *[F.sum(c).alias(c) for c in ("inserted", "updated", "total")])
            result = OutputResult(result.table, counts, result.rows, result.quarantined, payloads)
        results[name] = result
    return results
