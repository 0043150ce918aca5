"""Delimited files, sheet-like frames and landed payload files."""

from __future__ import annotations

import csv
import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ingestkit.functions.cleaning import strip
from ingestkit.session import setting

_RAW, _FILE, _ADDRESS = "_raw_row", "_grid_file", "_file_address"
_BUILT_IN_CHARSETS = ("iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8")

_NAMES = {"utf-8-sig": "utf-8", "utf8": "utf-8", "ascii": "us-ascii", "latin-1": "iso-8859-1"}
_JAVA_CHARSETS = "spark.sql.legacy.javaCharsets"


def _charset(spark: SparkSession, name: str) -> str:
    """The JVM's name of an encoding; those beyond Spark's short list need its setting for them."""
    name = _NAMES.get(name.lower(), name.lower())
    if name not in _BUILT_IN_CHARSETS:
        spark.conf.set(_JAVA_CHARSETS, "true")  # looked up when the files are read, so it has to stay
    return name


def read_csv(spark: SparkSession, options: Mapping) -> DataFrame:
    """First row is the header; names and values are stripped and every value is text.

    A byte-order mark is dropped, blank lines are skipped, missing cells of a short row are NULL. ``multiline: false`` lets
    Spark split large files, for data without line ends inside quotes.
    """
    path = options.get("path")
    if not path:
        raise ValueError("file options need a path")
    return _cells(spark, options, path, _reader(spark, options).csv(path).columns)


def _reader(spark: SparkSession, options: Mapping):
    return spark.read.options(
        header=True, sep=options.get("delimiter", ","), quote='"', escape='"',
        encoding=_charset(spark, options.get("encoding", "utf-8-sig")), multiLine=options.get("multiline", True), emptyValue="", mode="PERMISSIVE",
        # the check of the number of cells needs all of them
        columnPruning=False, columnNameOfCorruptRecord=_RAW,
    )


def _cells(spark: SparkSession, options: Mapping, path: str | list[str], header: Sequence[str], file: str | None = None) -> DataFrame:
    """The rows of files that share a header; ``file`` names a column for the address of a row's file."""
    raw = _reader(spark, options).schema(StructType([StructField(c, StringType()) for c in [*header, _RAW]])).csv(path)
    sep = options.get("delimiter", ",")
    # the reader gives NULL both for an empty cell and for one a short row lacks; only rows of an
    # unexpected width carry their text, and there the separators outside quotes tell which it is
    bare = F.regexp_replace(F.col(_RAW), '"(?:[^"]|"")*"', "")
    width = F.when(F.col(_RAW).isNull(), len(header)).otherwise(
        F.char_length(bare) - F.char_length(F.replace(bare, F.lit(sep), F.lit(""))) + 1)
    cells = []
    for i, name in enumerate(header):
        value = F.coalesce(strip(F.col(f"`{name}`")), F.when(width > i, F.lit("")))
        cells.append(value.alias(name.strip()))
    return raw.select(*cells, *([_address(F.col("_metadata.file_path")).alias(file)] if file else []))


def _address(path: Column) -> Column:
    """One spelling of a file's address: ``file:/a`` for ``file:///a``."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def _found(spark: SparkSession, path: str) -> list:
    """The files of a path, which may be a folder or a pattern."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, out = list(fs.globStatus(p) or []), []
    while found:
        status = found.pop()
        name = status.getPath().getName()
        if status.isDirectory():
            found += [s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
        elif status.getLen() or not name.startswith(("_", ".")):
            out.append((fs, status.getPath()))
    return out


def _header(spark: SparkSession, options: Mapping, fs, path) -> tuple[str, ...]:
    """Stripped names in the first line of a file that is not blank, made distinct as Spark does; nothing but that line is read."""
    charset = options.get("encoding", "utf-8-sig")
    if charset.lower().startswith(("utf-16", "utf-32", "utf16", "utf32")):
        return tuple(_reader(spark, options).csv(path.toString()).columns)
    stream, text = fs.open(path), ""
    try:
        while not text.strip() or text.count('"') % 2:
            line = stream.readLine()  # bytes as characters
            if line is None:
                break
            text += ("\n" if text else "") + line.encode("latin-1").decode({"utf-8": "utf-8-sig"}.get(charset.lower(), charset))
    finally:
        stream.close()
    names = next(csv.reader([text], delimiter=options.get("delimiter", ",")), [])
    names = [n.strip() for n in names]
    lowered = [n.lower() for n in names]
    return tuple(f"_c{i}" if not n else f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(names))


def read_csv_grid(spark: SparkSession, options: Mapping, contexts: Sequence[tuple[str, Mapping]]) -> tuple[DataFrame | None, list[str]]:
    """All files of a grid of ``(path, variables)``: rows with the variables of their contexts, and the errors of contexts
    whose file cannot be found or opened.

    Files that share a header, normally all, are one scan; the variables come by a join with the address of the file, so
    the plan does not grow with the grid. Two contexts of one path get its rows each.
    """
    groups: dict[tuple[str, ...], set[str]] = {}
    places, errors = [], []
    for path, values in contexts:
        try:
            files = _found(spark, path)
            if not files:
                raise FileNotFoundError(f"no file at {path}")
            for fs, file in files:
                header = _header(spark, options, fs, file)
                if header:  # an empty file has no rows
                    groups.setdefault(header, set()).add(file.toString())
                    places.append((file.toUri().toString(), *values.values()))
        except Exception as e:  # whatever keeps one context from being read leaves the others alone
            errors.append(f"{path}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
    if not places:
        return None, errors
    names = list(contexts[0][1])
    schema = StructType([StructField(c, StringType()) for c in [_FILE, *names]])
    grid = spark.createDataFrame(list(dict.fromkeys(places)), schema).withColumn(_FILE, _address(F.col(_FILE)))
    parts = []
    for header, files in groups.items():
        rows = _cells(spark, options, sorted(files), header, _ADDRESS)
        own = grid.select(_FILE, *[f"`{c}`" for c in names if c not in rows.columns])
        parts.append(rows.join(F.broadcast(own), F.col(_ADDRESS) == F.col(_FILE)).drop(_ADDRESS, _FILE))  # the task's own list
    return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts), errors


def normalize_sheet(df: DataFrame) -> DataFrame:
    """Header and cell rules of sheets: blank header → ``col_i``, all-NULL rows out, NULL → ``""``."""
    names = [str(c).strip() or f"col_{i}" for i, c in enumerate(df.columns)]
    named = df.toDF(*names).dropna(how="all")
    return named.select(*[F.coalesce(strip(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in names])


def read_payload_files(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """One payload per landed file: ``url`` (the file's address) and ``body``.

    Files in another charset are read as bytes and decoded in the JVM.
    """
    charset = _NAMES.get(charset.lower(), charset.lower())
    if charset == "utf-8":
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.input_file_name().alias("url"), F.col("value").alias("body"))
    raw = spark.read.format("binaryFile").load(path)
    with setting(spark, _JAVA_CHARSETS, "true"):  # the expression keeps what it is made with
        return raw.select(F.col("path").alias("url"), F.decode("content", charset).alias("body"))


def payload_frame(df: DataFrame, body: str, url: str | None = None, doc_id: str | None = None) -> DataFrame:
    """Any frame with a text column as ``(doc_id, url, body)`` payloads."""
    return df.select(
        (F.col(doc_id) if doc_id else F.lit(None).cast("bigint")).alias("doc_id"),
        (F.col(url) if url else F.lit("")).alias("url"),
        F.col(body).cast("string").alias("body"),
    )


def acceptable(payloads: DataFrame, status: str = "status", below: int = 500) -> DataFrame:
    """Payloads whose response status is below 500, or unknown."""
    if status not in payloads.columns:
        return payloads
    return payloads.where(F.coalesce(F.col(status) < below, F.lit(True)))
