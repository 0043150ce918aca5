"""Dotted paths (``data.items.0.title``, ``list.-1``) over JSON text and nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def _is_index(segment: str) -> bool:
    return segment.lstrip("-").isdigit()


def _step(segment: str) -> str:
    return f"['{segment}']"


def json_text_at(body: Column, path: str) -> Column:
    """Text of the value at ``path``; NULL when the path or the document is bad.

    A numeric segment is an index on a list and a key on an object; a negative one counts from the end.
    """
    pending = "$"
    current = body
    for segment in path.split("."):
        if not _is_index(segment):
            pending += _step(segment)
            continue
        if int(segment) < 0:
            holder = F.get_json_object(current, pending) if pending != "$" else current
            items = F.from_json(holder, "array<string>")
            from_list = F.try_element_at(items, F.lit(int(segment)))
        else:
            holder = F.get_json_object(current, pending) if pending != "$" else current
            from_list = F.get_json_object(holder, f"$[{segment}]")
        from_object = F.get_json_object(holder, "$" + _step(segment))
        current, pending = F.coalesce(from_list, from_object), "$"
    return F.get_json_object(current, pending) if pending != "$" else current


def column_at(root: Column, kind: DataType, path: str) -> Column | None:
    """The nested column at ``path`` by schema; None when the schema has no such path."""
    for segment in path.split("."):
        if isinstance(kind, StructType):
            if segment not in kind.fieldNames():
                return None
            root, kind = root.getField(segment), kind[segment].dataType
        elif isinstance(kind, MapType):
            root, kind = F.try_element_at(root, F.lit(segment)), kind.valueType
        elif isinstance(kind, ArrayType) and _is_index(segment):
            index = int(segment)
            root = F.try_element_at(root, F.lit(index + 1 if index >= 0 else index))
            kind = kind.elementType
        else:
            return None
    return root
