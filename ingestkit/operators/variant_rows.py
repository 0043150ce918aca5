"""Rows out of JSON payloads by Variant: one parse per payload, whatever is read from it.

The form for payloads of which many fields or changing parts are read. Against ``json_rows``: a payload with a repeated key
in one object is bad JSON here and gives no rows, and a number is written as Spark normalises it (1.50 is 1.5).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestkit.functions.paths import _is_index
from ingestkit.operators.json_rows import ORDINAL, ROW, slice_payload
from ingestkit.session import spread

_LIST = "array<variant>"


def _at(value: Column, path: str, kind: str) -> Column:
    """What lies at a path of names and positions; a position counts from the end if it is negative."""
    way = "$"
    for segment in path.split(".") if path else []:
        if not _is_index(segment):
            quote = "'" if "'" not in segment else '"'
            if quote in segment:
                raise ValueError(f"a key with both kinds of quotes cannot be read: {segment}")
            way += f"[{quote}{segment}{quote}]"
        elif int(segment) >= 0:
            way += f"[{int(segment)}]"
        else:
            value, way = F.try_element_at(F.try_variant_get(value, way, _LIST), F.lit(int(segment))), "$"
    return F.try_variant_get(value, way, kind)


def variant_rows(payloads: DataFrame, cfg: Mapping, body: str = "body") -> DataFrame:
    """``json_rows`` with ``_row`` a variant: ``(payload columns without body, _ordinal, _row)``."""
    root = _at(F.col("_parsed"), cfg.get("root_path", "") or "", "variant")
    # an object is read as a list of one
    single = F.when(F.schema_of_variant(F.col("_root")).startswith("OBJECT"), F.array("_root"))
    items = slice_payload(F.coalesce(F.try_variant_get(F.col("_root"), "$", _LIST), single), cfg.get("filters") or {})
    carried = [F.col(f"`{c}`") for c in payloads.columns if c != body]
    return (
        spread(payloads).select(*carried, F.try_parse_json(body).alias("_parsed")).select(*carried, root.alias("_root"))
        .select(*carried, items.alias("_items")).select(*carried, F.posexplode_outer("_items").alias(ORDINAL, ROW))
        .where(F.col(ORDINAL).isNotNull())
    )


def variant_field(field: Mapping) -> Column | None:
    """``json_field`` on a variant row: source, then path, as text. A null counts as absent."""
    tries = []
    if field.get("position") is not None:
        tries.append(_at(F.col(ROW), str(int(field["position"])), "string"))
    if field.get("source"):
        tries.append(F.try_variant_get(F.col(ROW), f"$['{field['source']}']" if "'" not in field["source"] else f'$["{field["source"]}"]', "string"))
    path = field.get("path") or field.get("selector")
    if path:
        tries.append(_at(F.col(ROW), path, "string"))
    return F.coalesce(*tries) if tries else None
