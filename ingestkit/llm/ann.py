"""Approximate nearest neighbours by adaptive dimension scans of probed lists (largest inner product).

Fit: k-means centroids on a bounded sample (``SAMPLE`` rows, the first by hash). How many lists a query probes is set by
measurement: the fewest that give ``RECALL`` on queries of the sample against brute force in the sample.

Index: every vector goes to the list of its best centroid and is rotated by one random orthogonal matrix, so that any
leading columns are a fair sample of its direction. Columns come in blocks of ``COLUMNS``.

Search: within a list, a query and a candidate have squared distance ``|q|^2 + |x|^2 - 2 q x``; the query's 20th best so far
bounds it. After each block of columns the partial distance, scaled up, is tested against that bound: beyond
``1 + EPSILON / sqrt(d)`` times the bound's root, the hypothesis that the candidate gets in is rejected and it is abandoned.
What survives all blocks is scored exactly, in double precision, on the original vectors.

Spark partitions the work: lists are cut into blocks of ``ROWS`` vectors and the queries of a list into blocks as large,
so a hot list is many tasks, and every pair of blocks is scanned once. A query keeps its best ``K + 1`` of each pair of
blocks. Equal vectors are one candidate that stands for its smallest ``K + 1`` ids: no more can be among the answers, so
thousands of copies cost one scan and lose none.

Cases: null vectors, vectors of zero length or norm, with null or non-finite components, or of another length than
most, take no part, nor do rows without an id; of rows that share an id the smallest vector counts; ties go to the smaller id;
with fewer candidates than K all are returned; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ingestkit.llm.common import fields, lookup, written

K, EVERY = 20, 20
SAMPLE, LISTS, ROWS, COLUMNS, EPSILON, RECALL = 8_192, 32, 4_096, 16, 2.1, 0.975


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n best lists of every row, best first."""
        return np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")[:, :n]


def fit(sample: np.ndarray, k: int = K, lists: int = LISTS, recall: float = RECALL) -> Index:
    random = np.random.Generator(np.random.PCG64(11))
    n, dims = sample.shape
    rotation = np.linalg.qr(random.normal(size=(dims, dims)))[0]
    centroids = sample[random.permutation(n)[:lists]].copy()
    for _ in range(15):
        home = np.argmax(sample @ centroids.T, axis=1)
        for c in range(len(centroids)):
            members = sample[home == c]
            mean = members.mean(axis=0) if len(members) else sample[int(random.integers(n))]
            centroids[c] = mean / (np.linalg.norm(mean) or 1.0)
    made = Index(centroids, rotation, len(centroids))
    asked = random.permutation(n)[:256]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    found = np.argsort(-scores, axis=1)[:, :min(k, n - 1)]
    home = np.argmax(sample @ centroids.T, axis=1)
    order = made.nearest(sample[asked], len(centroids))
    rank = np.argsort(order, axis=1)
    needed = np.take_along_axis(rank, home[found], axis=1) + 1
    for probes in range(1, len(centroids) + 1):
        if not needed.size or (needed <= probes).mean() >= recall:
            break
    made.probes = probes
    return made


def scan(queries: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> list[np.ndarray]:
    """For every query the places of candidates that may be among its k best, by the adaptive scan."""
    q, x = queries @ rotation, vectors @ rotation
    q2, x2 = (q ** 2).sum(axis=1), (x ** 2).sum(axis=1)
    first = min(len(x), max(4 * k, 256))
    dims = x.shape[1]
    scores = np.full((len(q), len(x)), -np.inf)
    scores[:, :first] = q @ x[:first].T  # bounds come from a first stretch that is scored in full
    if first < len(x):
        bound = np.partition(scores[:, :first], first - min(k, first), axis=1)[:, first - min(k, first)]
        limit = q2[:, None] + x2[None, first:] - 2 * bound[:, None]
        alive = np.ones(limit.shape, bool)
        partial = np.zeros(limit.shape)
        for at in range(0, dims, columns):
            to = min(dims, at + columns)
            qb, xb = q[:, at:to], x[first:, at:to]
            if alive.mean() > 0.2:  # most are alive: one matrix product is cheaper than gathering
                partial += (qb ** 2).sum(axis=1)[:, None] + (xb ** 2).sum(axis=1)[None] - 2 * (qb @ xb.T)
            else:
                a, b = np.nonzero(alive)
                partial[a, b] += ((qb[a] - xb[b]) ** 2).sum(axis=1)
            slack = (1 + epsilon / np.sqrt(to)) ** 2 if to < dims else 1 + 1e-9
            alive &= partial * (dims / to) <= np.maximum(limit, 0) * slack
        a, b = np.nonzero(alive)
        scores[a, b + first] = (q2[a] + x2[b + first] - partial[a, b]) / 2
    keep = min(k + 12, len(x))  # more than k, as rotated scores differ in the last digits
    best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
    return [row[np.isfinite(s[row])] for row, s in zip(best, scores)]


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: rows that take part, one per id, all of the most frequent length."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = vectors.where("vec_id IS NOT NULL").where(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("size")).count()
    usual = sizes.agg(F.max(F.struct("count", F.col("size").alias("n")))["n"]).first()[0]
    return good.where(F.size("v") == F.lit(usual or 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding",
           sample: int = SAMPLE, lists: int = LISTS, rows: int = ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by ``every`` its k nearest others."""
    spark = vectors.sparkSession
    usable = written(_usable(fields(vectors, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))), "ann-rows")
    # equal vectors are one class: its name is its smallest id, of its ids the smallest k + 1 can be answers
    ranked = usable.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    members = written(ranked.groupBy("v").agg(F.min("vec_id").alias("class"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-classes")
    asked = usable.where(F.col("vec_id") % every == 0)
    picked = [np.array(r[0]) for r in members.select("v", "class").orderBy(F.xxhash64("class")).limit(sample).select("v").collect()]
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not picked:
        return spark.createDataFrame([], schema)
    made = fit(np.array(picked), k, lists)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(made))  # a bounded number of centroids and one rotation

    def assign(n: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(shared.value)
            for batch in batches:
                if len(batch):
                    x = np.stack([np.array(v.values) for v in batch.column(1)])
                    best = index.nearest(x, min(n, len(index.centroids)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(best), pa.list_(pa.int64()))], names=["class", "v", "lists"])
        return step

    assigned = "class bigint, v array<double>, lists array<bigint>"
    classes = members.select("class", "v")
    candidates = written(classes.mapInArrow(assign(1), assigned).select("class", "v", F.element_at("lists", 1).alias("list")), "ann-index")
    seekers = asked.join(members.select("v", "class"), "v").select("vec_id", "class")
    wanted = written(seekers, "ann-queries")
    probing = classes.join(wanted.select("class").distinct(), "class", "left_semi").mapInArrow(assign(made.probes), assigned)
    probing = written(probing.select("class", "v", F.explode("lists").alias("list")), "ann-probes")

    # blocks of a list: every block of its vectors meets every block of its queries once
    sizes = candidates.groupBy("list").agg(F.count("*").alias("n")).join(
        probing.groupBy("list").agg(F.count("*").alias("m")), "list").select(
            F.col("list").alias("_l"), F.ceil(F.col("n") / rows).cast("int").alias("vs"), F.ceil(F.col("m") / rows).cast("int").alias("qs"))
    sizes = written(sizes, "ann-lists")
    sizes = lookup(sizes, sizes.count())
    cell = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = candidates.join(sizes, F.col("list") == F.col("_l")).select("list", cell(F.col("vs")).alias("vb"), each(F.col("qs")).alias("qb"), "class", "v")
    right = probing.join(sizes, F.col("list") == F.col("_l")).select("list", each(F.col("vs")).alias("vb"), cell(F.col("qs")).alias("qb"), "class", "v")

    def pair(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        index = pickle.loads(shared.value)
        out = {"query": [], "class": [], "score": []}
        if len(vs) and len(qs):
            vs = vs.sort_values("class")
            x, names = np.stack(vs["v"].to_numpy()), vs["class"].to_numpy()
            for begin in range(0, len(qs), 256):
                part = qs.iloc[begin:begin + 256]
                q = np.stack(part["v"].to_numpy())
                for name, vector, places in zip(part["class"], q, scan(q, x, index.rotation, k + 1)):
                    exact = x[places] @ vector
                    best = np.lexsort((names[places], -exact))[:k + 1]
                    out["query"].append(np.full(len(best), name))
                    out["class"].append(names[places][best])
                    out["score"].append(exact[best])
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, float if c == "score" else np.int64) for c, v in out.items()})

    keys = ["list", "vb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "query bigint, class bigint, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    best = written(found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r"), "ann-found")
    named = best.join(members.select("class", "ids"), "class").select("query", "score", "ids")
    answers = wanted.join(named, F.col("class") == F.col("query")).select(F.col("vec_id").alias("query_id"), "score", F.explode("ids").alias("vec_id"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (answers.where("vec_id != query_id").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
