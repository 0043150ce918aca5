"""XML rows as a Python table function: its columns follow the fields it is asked for."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# Executors need no copy of this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class XmlRows:
    """``(body, names, tag)`` → one row per element ``tag``: ``_ordinal`` and ``_row``, a struct of the named attributes or
    children as text. A payload that is no XML, or NULL, has no rows; elements before the fault are not read either."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.asked = None

    @staticmethod
    def analyze(body: AnalyzeArgument, names: AnalyzeArgument, tag: AnalyzeArgument) -> AnalyzeResult:
        if names.value is None:
            raise ValueError("the names of the fields must be constant")
        row = StructType()
        for name in str(names.value).split(","):
            row = row.add(name, StringType())
        return AnalyzeResult(StructType().add("_ordinal", IntegerType()).add("_row", row))

    def eval(self, body, names, tag) -> Iterator[tuple]:
        from xml.etree import ElementTree

        if names != self.asked:  # split once per partition
            self.asked, self.names = names, names.split(",")
        if body is None:
            return
        try:
            root = ElementTree.fromstring(body)
        except ElementTree.ParseError:
            return
        for ordinal, element in enumerate(root.iter(tag)):
            yield ordinal, tuple(element.get(n, element.findtext(n)) for n in self.names)


xml_rows = udtf(XmlRows)
