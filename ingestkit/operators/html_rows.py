"""Rows, cells, attributes and page variables out of HTML payloads, without any shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestkit.functions.cleaning import strip
from ingestkit.functions.columns import let
from ingestkit.functions.html_nodes import below, parse_html, text_of
from ingestkit.functions.selectors import select_all
from ingestkit.operators.json_rows import ORDINAL, ROW, slice_payload
from ingestkit.session import spread

DOM = "_dom"


# Pages are far larger than the rows the default Arrow batch (10,000 rows) is meant for.
PAGES_PER_BATCH = "1000"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def with_nodes(payloads: DataFrame, body: str = "body") -> DataFrame:
    if DOM in payloads.columns:
        return payloads
    conf = payloads.sparkSession.conf
    if conf.get(_BATCH_ROWS, None) is None:
        conf.set(_BATCH_ROWS, PAGES_PER_BATCH)
    return spread(payloads).withColumn(DOM, parse_html(F.col(body)))


def _value(node: Column, texts: Column, field: Mapping) -> Column:
    """Attribute (missing → empty) or text of a node, stripped unless switched off; NULL for no node."""
    attr = field.get("attr")

    def read(n: Column) -> Column:
        value = (F.coalesce(F.try_element_at(n["attrs"], F.lit(attr.lower())), F.lit("")) if attr
                 else text_of(texts, n))
        return F.when(n.isNotNull(), strip(value) if field.get("strip", True) else value)

    return let(node, read)


def _html_field(row: Column, cells: Column | None, nodes: Column, texts: Column, field: Mapping) -> Column:
    column, selector = field.get("column"), field.get("selector")
    if column is not None:
        target = F.get(cells, F.lit(int(column))) if int(column) >= 0 else F.try_element_at(cells, F.lit(int(column)))
        if selector:
            target = let(target, lambda cell: F.get(select_all(selector, nodes, below(nodes, cell)), F.lit(0)))
        return _value(target, texts, field)
    if selector:
        found = select_all(selector, nodes, below(nodes, row))
        if field.get("multiple"):
            values = F.transform(found, lambda n: _value(n, texts, field))
            return F.nullif(values, F.array().cast("array<string>"))
        return _value(F.get(found, F.lit(0)), texts, field)
    return _value(row, texts, field)


def reads_html(field: Mapping) -> bool:
    """Fields with a constant value, or only a dict path, take nothing from the markup."""
    return "value" not in field


def html_rows(payloads: DataFrame, cfg: Mapping, body: str = "body") -> DataFrame:
    """One row per element matching ``row_selector``: ``(payload columns, _ordinal, _row)``.

    ``_row`` is a struct with one member per markup field. The fields are computed inside the
    page's node array *before* it is exploded, so the page is never copied once per row.
    """
    selector = cfg.get("row_selector") or ""
    carried = [c for c in payloads.columns if c not in (body, DOM)]
    fields = [f for f in cfg.get("fields", ()) if reads_html(f)]
    if not selector:
        schema = "struct<" + ",".join(f"`{f['name']}`:string" for f in fields) + ">" if fields else "struct<_none:string>"
        return (payloads.where(F.lit(False))
                .select(*carried, F.lit(0).alias(ORDINAL), F.lit(None).cast(schema).alias(ROW)))
    nodes, texts = F.col(DOM)["nodes"], F.col(DOM)["texts"]
    needs_cells = any(f.get("column") is not None for f in fields)

    def members(row: Column, cells: Column | None) -> Column:
        values = [_html_field(row, cells, nodes, texts, f).alias(f["name"]) for f in fields]
        return F.struct(*values) if values else F.struct(F.lit(None).cast("string").alias("_none"))

    def one(row: Column) -> Column:
        if not needs_cells:
            return members(row, None)
        # the cell list is found once for all fields of the row
        return let(F.filter(below(nodes, row), lambda n: n["tag"].isin("td", "th")), lambda c: members(row, c))

    found = slice_payload(select_all(selector, nodes), cfg.get("filters") or {})
    return (
        with_nodes(payloads, body)
        .select(*carried, F.transform(found, one).alias("_items"))
        .select(*carried, F.posexplode_outer("_items").alias(ORDINAL, ROW))
        # the outer form keeps the optimizer from evaluating the parse a second time in an
        # inferred "array is not empty" filter
        .where(F.col(ORDINAL).isNotNull())
    )


def html_field(field: Mapping) -> Column | None:
    return F.col(ROW).getField(field["name"]) if reads_html(field) else None


def page_vars(payloads: DataFrame, cfg: Mapping, body: str = "body") -> DataFrame:
    """Page-level variables as columns: first match per selector, ``""`` when nothing matches.

    Text is taken raw, without stripping or cleaning; an entry that is not a mapping is a constant.
    """
    selecting = {k: v for k, v in cfg.items() if isinstance(v, Mapping) and v.get("selector")}
    constants = {k: F.lit(v) for k, v in cfg.items() if not isinstance(v, Mapping)}
    if not selecting:
        return payloads.withColumns(constants) if constants else payloads
    df = with_nodes(payloads, body)
    nodes, texts = F.col(DOM)["nodes"], F.col(DOM)["texts"]
    found = {}
    for name, var in selecting.items():
        node = F.get(select_all(var["selector"], nodes), F.lit(0))
        value = _value(node, texts, {"attr": var.get("attr"), "strip": False})
        found[name] = F.coalesce(value, F.lit(""))
    return df.withColumns({**constants, **found})


def node_table(payloads: DataFrame, key: Sequence[str], body: str = "body") -> DataFrame:
    """The nodes themselves as rows, for ad-hoc work: key columns, node members and stripped text."""
    df = with_nodes(payloads, body)
    nodes, texts = F.col(DOM)["nodes"], F.col(DOM)["texts"]
    flat = F.transform(nodes, lambda n: F.struct(
        n["idx"].alias("node_id"), n["parent"].alias("parent_id"), n["tag"].alias("tag"),
        n["attrs"].alias("attrs"), strip(text_of(texts, n)).alias("text")))
    return df.select(*key, F.explode(flat).alias("_n")).select(*key, "_n.*")
