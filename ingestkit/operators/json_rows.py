"""Rows out of JSON payloads: ``root_path`` → list of records → one row each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ingestkit.functions.paths import _is_index, json_text_at
from ingestkit.session import spread

ROW = "_row"
ORDINAL = "_ordinal"


def _top_keys(fields: Sequence[Mapping]) -> list[str]:
    """First segments of every path a field may read: only these are kept by the parse."""
    keys: list[str] = []
    for field in fields:
        for path in (field.get("source"), field.get("path"), field.get("selector")):
            if path:
                # `source` is one key, dots included; paths are split
                keys.append(path if path == field.get("source") else path.split(".")[0])
    return list(dict.fromkeys(keys))


def _member(key: str) -> str:
    """Name of a key's struct member: Spark takes names that differ only in case for one, so keys with capitals are spelt
    in hexadecimal."""
    return key if key == key.lower() else f"_{key.encode().hex()}"


def _record_type(keys: Sequence[str]) -> StructType:
    return StructType([StructField(k, StringType()) for k in keys or ["_none"]])


def _nest(path: Sequence[str], leaf) -> StructType:
    kind = leaf
    for segment in reversed(path):
        kind = StructType([StructField(segment, kind)])
    return kind


def _records(body: Column, root_path: str, keys: Sequence[str]) -> Column:
    """ARRAY<STRUCT> of the records; NULL when there are none.

    One parse with a pruned schema serves documents whose root is a list of objects. The
    coalesce falls back, only for the documents that need it, to one object as root and to lists
    that mix objects with other values.
    """
    record = _record_type(keys)
    rows = ArrayType(record)
    named = ArrayType(StructType([StructField(_member(f.name), f.dataType) for f in record.fields]))
    segments = root_path.split(".") if root_path else []
    if not segments or any(_is_index(s) for s in segments):
        root = json_text_at(body, root_path) if segments else body
        direct = F.from_json(root, rows)
    else:
        root = json_text_at(body, root_path)
        direct = F.from_json(body, _nest(segments, rows))
        for segment in segments:
            direct = direct.getField(segment)
    # an object is read as a list of one; where the path has no index it is typed on the way, so that a text which happens
    # to hold JSON stays a text
    if segments and not any(_is_index(s) for s in segments):
        one = F.from_json(body, _nest(segments, record))
        some = F.from_json(body, _nest(segments, ArrayType(StringType())))
        for segment in segments:
            one, some = one.getField(segment), some.getField(segment)
        single = F.when(one.isNotNull(), F.array(one))
        mixed = F.transform(some, lambda e: F.from_json(e, record))
        return F.coalesce(direct, single, mixed).cast(named)
    single = F.from_json(root, rows)
    mixed = F.transform(F.from_json(root, ArrayType(StringType())), lambda e: F.from_json(e, record))
    return (F.coalesce(direct, single, mixed) if segments else F.coalesce(direct, mixed)).cast(named)


def _lists(body: Column, root_path: str) -> Column:
    root = json_text_at(body, root_path) if root_path else body
    direct = F.from_json(root, ArrayType(ArrayType(StringType())))
    mixed = F.transform(F.from_json(root, ArrayType(StringType())),
                        lambda e: F.from_json(e, ArrayType(StringType())))
    return F.coalesce(direct, mixed)


def json_rows(payloads: DataFrame, cfg: Mapping, body: str = "body") -> DataFrame:
    """Explode payloads to ``(payload columns without body, _ordinal, _row, _size)``.

    ``_row`` is a struct of the first path segments, or a list under ``array_index_mapping``.
    A scalar root, bad JSON and a missing path give no rows. No shuffle.
    """
    text = F.col(body)
    root_path = cfg.get("root_path", "") or ""
    if cfg.get("array_index_mapping"):
        items = _lists(text, root_path)
    else:
        items = _records(text, root_path, _top_keys(cfg.get("fields", ())))
    carried = [c for c in payloads.columns if c != body]
    items = slice_payload(items, cfg.get("filters") or {})
    return (
        spread(payloads).select(*carried, items.alias("_items"))
        .select(*carried, F.posexplode_outer("_items").alias(ORDINAL, ROW))
        # the outer form keeps the optimizer from evaluating the parse a second time in an
        # inferred "array is not empty" filter
        .where(F.col(ORDINAL).isNotNull())
    )


def slice_payload(items: Column, filters: Mapping) -> Column:
    """skip → head → tail on the array itself, before it becomes rows."""
    skip, head, tail = (int(filters.get(k) or 0) for k in ("skip_lines", "head", "tail"))
    if skip > 0:
        items = F.slice(items, skip + 1, F.greatest(F.size(items) - skip, F.lit(0)))
    if head > 0:
        items = F.slice(items, 1, head)
    if tail > 0:
        items = F.slice(items, F.greatest(F.size(items) - tail, F.lit(0)) + 1, F.lit(tail))
    return items


def json_field(field: Mapping, positional: bool = False) -> Column | None:
    """Extraction of one field from ``_row``: position, then source, then path. A null counts as absent."""
    row = F.col(ROW)
    tries: list[Column] = []
    if positional:
        if field.get("position") is not None:
            index = int(field["position"])
            tries.append(F.get(row, F.lit(index)) if index >= 0 else F.try_element_at(row, F.lit(index)))
    else:
        if field.get("source"):
            tries.append(row.getField(_member(field["source"])))
        path = field.get("path") or field.get("selector")
        if path:
            first, _, rest = path.partition(".")
            top = row.getField(_member(first))
            tries.append(json_text_at(top, rest) if rest else top)
    if not tries:
        return None
    return F.coalesce(*tries) if len(tries) > 1 else tries[0]
