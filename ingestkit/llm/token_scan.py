"""Token counts from flat token files without an index: a scan for end-of-document identifiers.

A flat file is nothing but token identifiers of fixed width, documents ending in a separator. It is read in blocks that
know nothing of documents. Per block one vectorised comparison finds the separators; the block is summed up by their
number, the tokens before the first and after the last, and the lengths between. A prefix scan over the blocks of a file
(running sums of tokens and separators, running maximum of separator places), first within runs of ``RUN`` blocks and then
over the runs, gives every block the number of its first document and the tokens that reach into it, so a document may
span any number of blocks.

``write_files`` makes such files: every task writes the stream of its documents into a raw file of the shared folder, and apart
from that a catalogue of the documents' ids in stream order, which the scan does not see. ``read_files`` reads raw files of
any size, each by many tasks. Where the shared folder is no file system of the tasks, ``write_tokens`` writes the same
stream as rows of blocks. A file's name holds the attempt that wrote it, and only the catalogue of attempts that succeeded
is read: what a lost executor has left behind counts for nothing.

Cases: null and empty texts are documents of 0 tokens; tokens behind the last separator of a file are a last document
that is not ``finished``; a file without separators is one such document; a separator's text inside a document is
ordinary text; repeated rows are documents of their own; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ingestkit.llm.common import fields, written
from ingestkit.session import shared_dir

TOKENIZER, SEPARATOR, WIDTH, BLOCK, RUN, TASKS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50_256, 2, 1 << 16, 1_024, 20_000

#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_TYPES = {2: "<u2", 4: "<u4", 8: "<u8"}


def encoder(ranks: bytes, pattern: str = PATTERN):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def write_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR,
                 width: int = WIDTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``file, block, tokens`` (binary) and the catalogue ``file, first, ids``.

    The rank file is read by the driver and sent along, as it need not be on the executors.
    """
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(ranks.value), TaskContext.get().partitionId()
        held, waiting, number, done = [], 0, 0, 0

        def row(kind: str, at: int, tokens: bytes | None, ids: pa.Array) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([file], pa.int64()), pa.array([at], pa.int64()),
                                               pa.array([tokens], pa.binary()), lists], names=["kind", "file", "at", "tokens", "ids"])

        for batch in batches:
            for cell in batch.column(1):
                ids = encode.encode_ordinary(cell.as_py() or "")
                held.append(np.array([*ids, separator], _TYPES[width]))
                waiting += len(held[-1])
                if waiting >= block:
                    flat = np.concatenate(held)
                    whole = len(flat) // block * block
                    for k in range(0, whole, block):
                        yield row("block", number, flat[k:k + block].tobytes(), batch.column(0)[:0])
                        number += 1
                    held, waiting = [flat[whole:]], len(flat) - whole
            yield row("ids", done, None, batch.column(0))
            done += len(batch)
            empty = batch.column(0)[:0]
        if waiting:
            yield row("block", number, np.concatenate(held).tobytes(), empty)

    named = fields(docs, doc_id=id_col, text=text_col)
    kind = named.schema["doc_id"].dataType.simpleString()
    both = written(named.mapInArrow(step, f"kind string, file bigint, at bigint, tokens binary, ids array<{kind}>"), "tokens")
    return (both.where("kind = 'block'").select("file", F.col("at").alias("block"), "tokens"),
            both.where("kind = 'ids'").select("file", F.col("at").alias("first"), "ids"))


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as tasks open it, if it lies in a file system they mount (else None)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(p).toUri().getPath() if system.getUri().getScheme() == "file" else None


def write_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
                separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """Raw token files in ``folder``; returns the catalogue ``file, first, ids``, written."""
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context, done = encoder(ranks.value), TaskContext.get(), 0
        name = f"{context.partitionId():08d}-{context.taskAttemptId()}"
        out = None
        for batch in batches:
            out = out or open(f"{folder}/{name}", "wb")
            for cell in batch.column(1):
                out.write(np.array([*encode.encode_ordinary(cell.as_py() or ""), separator], _TYPES[width]).tobytes())
            lists = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([done], pa.int64()), lists], names=["file", "first", "ids"])
            done += len(batch)
        if out:
            out.close()  # before the task ends, and with it before its rows count

    os.makedirs(folder, exist_ok=True)
    named = fields(docs, doc_id=id_col, text=text_col)
    kind = named.schema["doc_id"].dataType.simpleString()
    return written(named.mapInArrow(step, f"file string, first bigint, ids array<{kind}>"), "token-catalogue")


def _open_shared(path: str) -> BinaryIO:
    return open(path.removeprefix("file:"), "rb")


def read_files(spark: SparkSession, path: str, width: int = WIDTH, block: int = BLOCK, opened: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """Raw token files below ``path`` as ``file, block, tokens``. Spark only lists them; tasks read ``RUN`` blocks each, one at a time.

    ``opened`` opens a listed path for reading at any place; it runs in the tasks. Without it ``file:`` paths are opened in
    the shared folder, and files of other stores are handed over whole by Spark, which refuses those above 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind, size = "file string, block bigint, tokens binary", width * block

    def row(name: str, k: int, raw: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([raw], pa.binary())], names=["file", "block", "tokens"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, run in zip(*(c.to_pylist() for c in batch.columns)):
                with (opened or _open_shared)(name) as f:
                    for k in range(run * RUN, min((run + 1) * RUN, -(-length // size))):
                        f.seek(k * size)
                        raw = f.read(min(size, length - k * size))
                        if len(raw) < min(size, length - k * size):
                            raise OSError(f"{name} ends before its listed length of {length} bytes")
                        yield row(name, k, raw)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                raw = memoryview(content.as_buffer())
                for k in range(0, len(raw), size):
                    yield row(name.as_py(), k // size, bytes(raw[k:k + size]))

    def ranged(some: DataFrame) -> DataFrame:
        last = F.floor((F.col("length") - 1) / F.lit(size * RUN)).cast("long")
        runs = some.select("path", "length").where("length > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        tasks = min(runs.count(), TASKS)
        return runs.repartition(max(1, tasks), "path", "run").mapInArrow(ranges, kind)

    if opened:
        return ranged(files)
    local = F.col("path").startswith("file:")
    others = files.where(~local)
    if others.select("path").isEmpty():
        return ranged(files)
    return ranged(files.where(local)).unionByName(others.select("path", "content").mapInArrow(whole, kind))


def summarise(tokens: bytes, separator: int, width: int) -> tuple[int, int, int, int, list[int]]:
    """Tokens, separators, tokens before the first separator and after the last, lengths between separators."""
    flat = np.frombuffer(tokens, _TYPES[width])
    ends = np.flatnonzero(flat == separator)
    if not len(ends):
        return len(flat), 0, len(flat), len(flat), []
    return len(flat), len(ends), int(ends[0]), int(len(flat) - ends[-1] - 1), (np.diff(ends) - 1).tolist()


def count(blocks: DataFrame, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """``file, ordinal, n_tokens, finished`` for every document of the files."""
    kind = blocks.schema["file"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, seps, head, tail, inner = zip(*(summarise(t.as_buffer(), separator, width) for t in batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (n, seps, head, tail)), pa.array(inner, pa.list_(pa.int64()))],
                names=["file", "block", "n", "seps", "head", "tail", "inner"])

    seen = blocks.select("file", "block", "tokens").mapInArrow(
        step, f"file {kind}, block bigint, n bigint, seps bigint, head bigint, tail bigint, inner array<bigint>")
    seen = written(seen.withColumn("run", F.floor(F.col("block") / RUN)), "token-blocks")
    # within a run: tokens and separators before the block, and where after the run's start the last document began
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    local = seen.withColumn("t", F.coalesce(F.sum("n").over(inside), nothing)).withColumn("s", F.coalesce(F.sum("seps").over(inside), nothing))
    local = local.withColumn("begun", F.when(F.col("seps") > 0, F.col("t") + F.col("n") - F.col("tail"))).withColumn("b", F.max("begun").over(inside))
    runs = local.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max("begun").alias("begun"), F.max("block").alias("last"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = (runs.withColumn("rt", F.coalesce(F.sum("n").over(over), nothing)).withColumn("rs", F.coalesce(F.sum("seps").over(over), nothing))
               .withColumn("_begun", F.col("rt") + F.col("begun")).withColumn("rb", F.coalesce(F.max("_begun").over(over), nothing))
               .withColumn("end", F.max("last").over(Window.partitionBy("file"))).select("file", "run", "rt", "rs", "rb", "end"))
    placed = local.join(carried, ["file", "run"])
    reach = F.col("rt") + F.col("t") - F.coalesce(F.col("rt") + F.col("b"), F.col("rb"))  # tokens of the document that reaches in
    closed = F.when(F.col("seps") > 0, F.concat(F.array(reach + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("seps") > 0, F.col("tail")).otherwise(reach + F.col("n"))
    ended = placed.select("file", (F.col("rs") + F.col("s")).alias("_first"), F.posexplode(closed).alias("_k", "n_tokens")).select(
        "file", (F.col("_first") + F.col("_k")).alias("ordinal"), "n_tokens", F.lit(True).alias("finished"))
    open_ = placed.where((F.col("block") == F.col("end")) & (rest > 0)).select(
        "file", (F.col("rs") + F.col("s") + F.col("seps")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("finished"))
    return ended.unionByName(open_)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of every document, counted in the flat files its tokens are written to."""
    spark = docs.sparkSession
    folder = local_folder(spark, f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}")
    if folder:
        catalogue = write_files(docs, folder, tokenizer)
        counted = count(read_files(spark, f"file:{folder}")).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    else:
        blocks, catalogue = write_tokens(docs, tokenizer)
        counted = count(blocks)
    named = catalogue.select("file", "first", F.posexplode("ids").alias("_k", "doc_id")).select("file", (F.col("first") + F.col("_k")).alias("ordinal"), "doc_id")
    return named.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
