"""Query sources: SQL over registered views, or a query sent to a remote database."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_DRIVERS = {"mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306),
            "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432),
            "sqlite": ("jdbc:sqlite:{path}", 0)}


def sql_source(spark: SparkSession, query: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Rows of a SQL query; ``views`` are bound for this query only, no names are registered."""
    if not query or not query.strip():
        raise ValueError("db options need a query")
    views = views or {}
    text = query
    # braces of the caller's own must survive the named-argument formatter
    text = text.replace("{", "{{").replace("}", "}}")
    for name in sorted(views, key=len, reverse=True):
        text = re.sub(rf"(?<![\w.]){re.escape(name)}(?![\w(])", "{" + name + "}", text)
    return spark.sql(text, **views) if views else spark.sql(query)


def env_value(text, environ: Mapping[str, str] | None = None):
    """``${NAME}`` → the environment variable; other values stay as they are."""
    environ = os.environ if environ is None else environ
    if not isinstance(text, str):
        return text
    return re.sub(r"\$\{(\w+)\}", lambda m: environ.get(m.group(1), ""), text)


def jdbc_options(options: Mapping, environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """Reader options of a remote query. ``partition`` gives the column and bounds for parallel reads."""
    kind = options.get("type", "sqlite")
    if kind not in _DRIVERS:
        raise ValueError(f"unsupported database type: {kind}")
    if not options.get("query"):
        raise ValueError("db options need a query")
    template, port = _DRIVERS[kind]
    values = {"host": options.get("host", "localhost"), "port": options.get("port", port),
              "database": options.get("database", ""), "path": options.get("path", "")}
    out = {"url": template.format(**values), "fetchsize": str(options.get("fetchsize", 10_000))}
    for name in ("user", "password"):
        if options.get(name) is not None:
            out[name] = env_value(options[name], environ)
    part = options.get("partition")
    if part:
        # a parallel read splits a table expression by ranges of one column
        out["dbtable"] = f"({options['query']}) q"
        out.update(partitionColumn=part["column"], lowerBound=str(part["lower"]),
                   upperBound=str(part["upper"]), numPartitions=str(part["partitions"]))
    else:
        out["query"] = options["query"]
    return out


def read_jdbc(spark: SparkSession, options: Mapping) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(options)).load()

