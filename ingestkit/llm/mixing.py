"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Native throughout: aggregates, one window over the table of sources, higher-order functions, joins with small counted
tables. What each document gives follows from hashes of its own values, so reruns and recomputed tasks agree.

1. Targets. The sources, by code point with null last, weigh 1, 2, 3, 1, …; they share the words of all documents by
   weight, and no source gets more than ``cap`` times its own words (water filling: the excess goes to the others).
2. Draws. A source gives every document ``floor(target / words)`` times, and once more the documents whose hash lies
   below a cut. The cut comes from a histogram over 4,096 hash ranges and a ranking inside the one range it falls in, so
   a hot source is never ordered as a whole. Words taken miss the target by half a document at most.
3. Splitting tree. The draws of a source fall into blocks by hash; the number of blocks follows the words taken and is
   about ``shards * blocks_per_shard`` in all. A node of the tree owns a range of shards and an exact quota of blocks per
   source. Its left child draws its share of the blocks without replacement, source by source, from the hypergeometric
   distribution (inversion around the mode); the right child keeps the rest. Leaves are the quotas of the shards.
4. Blocks. The blocks of a source are permuted by hash and dealt in runs as long as the quotas: disjoint, none left over.
5. Local shuffle. Inside a shard the rows follow a hash (``place``); ``mixed_rows`` writes them in that order.

Cases: null or empty text and text without words has size 0; a null source is a source; a null id is a value like any
other; equal rows tie and are drawn together; a table without words has targets 0 and gives every document 0 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ingestkit.llm.common import WORD, lookup, unit, written

SHARDS, BLOCKS_PER_SHARD, CAP, SHARD_BYTES = 16, 64, 3, 1 << 29


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.struct("*").alias("doc"), F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
                          F.coalesce(F.md5(text), F.lit("")))).alias("h"))


def targets(by_source: DataFrame, cap: int = CAP) -> DataFrame:
    """``source, words`` → also ``target`` (double) and ``ordinal``. One row per source: the windows see that table only."""
    ordered = by_source.withColumn("ordinal", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ordered.withColumn("weight", (F.col("ordinal") - 1) % 3 + 1).withColumn("most", F.col("words") * cap)
    entire = Window.partitionBy()
    tightest = Window.orderBy(F.col("most") / F.col("weight"), "ordinal")
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("words").over(entire) - F.coalesce(F.sum("most").over(before), F.lit(0)))
             / (F.sum("weight").over(entire) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # as long as sources are capped the level rises, afterwards it falls: its maximum is the level of the uncapped
    return (weighed.withColumn("level", level).withColumn("level", F.max("level").over(entire))
            .withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
            .select("source", "words", "ordinal", "target"))


def _cuts(keyed: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the greatest hash drawn once more (null: none) and the words that adds."""
    slot = F.substring("h", 1, 3).alias("slot")
    filled = keyed.groupBy("source", slot).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (filled.withColumn("after", F.sum("words").over(upto)).withColumn("before", F.col("after") - F.col("words"))
              .drop("words").join(goals.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s")))
              .drop("_s"))
    whole = ranges.where(F.col("after") <= F.col("rest")).groupBy("source").agg(
        F.max("after").alias("words"), F.max(F.concat("slot", F.lit("g"))).alias("cut"))  # "g" sorts behind every hex digit
    partly = ranges.where((F.col("after") > F.col("rest")) & (F.col("before") <= F.col("rest"))).select(
        F.col("source").alias("_s"), F.col("slot").alias("_slot"), "before", "rest")
    inside = keyed.select("source", "size", "h", slot).join(
        partly, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_slot")))
    run = Window.partitionBy("source", "slot").orderBy("h")  # a range frame: rows of equal hash come and go together
    drawn = (inside.withColumn("after", F.col("before") + F.sum("size").over(run))
             .withColumn("tied", F.sum("size").over(Window.partitionBy("source", "slot", "h")))
             .where(F.col("after") - F.col("tied") / 2 <= F.col("rest"))
             .groupBy("source").agg(F.max("after").alias("words"), F.max("h").alias("cut")))
    return whole.unionByName(drawn).groupBy("source").agg(F.max("words").alias("extra"), F.max("cut").alias("cut"))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` fall into ``draws`` without replacement, by inversion of ``u``.

    Weights are relative to the mode, where they are 1, and follow the ratio of neighbours outwards: nothing overflows.
    The support is searched from the mode upwards and then downwards, a fixed order in which inversion is exact.
    """
    low = F.greatest(F.lit(0).cast("long"), draws + good - total)
    high = F.least(draws, good)
    mode = F.greatest(low, F.least(high, F.floor((draws + 1) * (good + 1) / (total + 2)).cast("long")))

    def with_mode(m: Column) -> Column:
        def up(w: Column, k: Column) -> Column:  # weight of k from that of k - 1
            return w * ((good - k + 1) * (draws - k + 1)) / (k * (total - good - draws + k))

        def down(w: Column, j: Column) -> Column:  # weight of j from that of j + 1
            return w * ((j + 1) * (total - good - draws + j + 1)) / ((good - j) * (draws - j))

        ups = F.filter(F.sequence(m, high), lambda k: k > m)
        downs = F.filter(F.sequence(m, low, F.lit(-1).cast("long")), lambda k: k < m)
        ups = F.when(high > m, ups).otherwise(F.array().cast("array<bigint>"))
        downs = F.when(low < m, downs).otherwise(F.array().cast("array<bigint>"))
        summed = lambda ks, step: F.aggregate(
            ks, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
            lambda a, k: _bound(step(a["w"], k), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"))), lambda a: a["s"])
        start = u * (1.0 + summed(ups, up) + summed(downs, down)) - 1.0
        searched = lambda ks, step, left, found: F.aggregate(
            ks, F.struct(F.lit(1.0).alias("w"), left.alias("x"), found.alias("k")),
            lambda a, k: _bound(step(a["w"], k), lambda w: F.struct(
                w.alias("w"), (a["x"] - w).alias("x"), F.when((a["x"] >= 0) & (a["x"] - w < 0), k).otherwise(a["k"]).alias("k"))),
            lambda a: F.struct(a["x"].alias("x"), a["k"].alias("k")))
        return _bound(searched(ups, up, start, m),
                      lambda first: searched(downs, down, first["x"], first["k"])["k"])

    return _bound(mode, with_mode)


def quota_tree(blocks: DataFrame, shards: int, seed: str = "mix") -> DataFrame:
    """``ordinal, blocks`` per source → ``shard, ordinal, quota``: exact, and as large per shard as the division allows.

    A node holds the quotas of all sources in one array, which is as long as there are sources.
    """
    nodes = blocks.agg(F.array_sort(F.collect_list(F.struct(
        F.col("ordinal").cast("long").alias("ordinal"), F.col("blocks").cast("long").alias("q")))).alias("qs")).select(
        F.lit(0).alias("low"), F.lit(shards).alias("high"), "qs")
    width = shards
    while width > 1:
        width = -(-width // 2)
        low, high = F.col("low"), F.col("high")
        middle = low + F.ceil((high - low) / 2).cast("int")
        total = F.aggregate("qs", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        share = F.floor(total * (middle - low) / F.greatest(high - low, F.lit(1))).cast("long")

        def draw(acc: Column, x: Column) -> Column:
            u = unit(F.lit(seed), F.col("low").cast("string"), F.col("high").cast("string"), x["ordinal"].cast("string"))
            got = F.when(acc["rest"] > 0, hypergeometric(acc["rest"], x["q"], acc["left"], u)).otherwise(F.lit(0).cast("long"))
            return _bound(got, lambda d: F.struct(
                (acc["left"] - d).alias("left"), (acc["rest"] - x["q"]).alias("rest"),
                F.concat(acc["out"], F.array(F.struct(x["ordinal"].alias("ordinal"), d.alias("q")))).alias("out")))

        empty = F.array().cast("array<struct<ordinal:bigint,q:bigint>>")
        left = F.aggregate("qs", F.struct(share.alias("left"), total.alias("rest"), empty.alias("out")), draw, lambda a: a["out"])
        split = nodes.select("low", "high", "qs", middle.alias("mid"),
                             F.when(high - low > 1, left).otherwise(F.col("qs")).alias("lefts"))
        rights = F.zip_with("qs", "lefts", lambda a, b: F.struct(a["ordinal"].alias("ordinal"), (a["q"] - b["q"]).alias("q")))
        kept = F.array(F.struct(F.col("low").alias("low"), F.col("mid").alias("high"), F.col("lefts").alias("qs")),
                       F.struct(F.col("mid").alias("low"), F.col("high").alias("high"), rights.alias("qs")))
        nodes = split.select(F.inline(kept)).where(F.col("low") < F.col("high"))
    return nodes.select(F.col("low").alias("shard"), F.inline("qs")).withColumnRenamed("q", "quota")


def _dealt(sources: DataFrame, shards: int, seed: str) -> DataFrame:
    """``ordinal, blocks`` → ``ordinal, shard_of`` (array: the shard of every block)."""
    quotas = quota_tree(sources, shards, seed)
    upto = Window.partitionBy("ordinal").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    runs = quotas.withColumn("until", F.sum("quota").over(upto)).select("ordinal", "shard", "until", "quota")
    order = Window.partitionBy("ordinal").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("ordinal"), F.col("block"))), "block")
    blocks = (sources.select("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
              .withColumn("rank", F.row_number().over(order)))
    ranged = runs.select(F.col("ordinal").alias("_o"), "shard", "until", (F.col("until") - F.col("quota")).alias("from"))
    placed = blocks.join(ranged, (F.col("ordinal") == F.col("_o")) & (F.col("rank") > F.col("from")) & (F.col("rank") <= F.col("until")))
    return placed.groupBy("ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "shard"))), lambda x: x["shard"]).alias("shard_of"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP,
        shards: int = SHARDS, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: str = "mix") -> DataFrame:
    """Every row of ``docs`` once: ``doc`` (the row as a struct), ``size``, ``source_words``, ``target`` and ``draws``,
    an array with the ``shard`` and the ``place`` in it for every time the mix takes the document."""
    keyed = _keyed(docs, id_col, text_col, source_col, seed)
    by_source = written(targets(keyed.groupBy("source").agg(F.sum("size").alias("words")), cap), "mix-targets")
    goals = by_source.withColumn("times", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", F.col("target") - F.col("times") * F.col("words"))
    cuts = _cuts(keyed, goals.where(F.col("rest") > 0)).select(F.col("source").alias("_s"), "extra", "cut")
    drawn = (goals.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
             .withColumn("taken", F.col("times") * F.col("words") + F.coalesce("extra", F.lit(0))))
    drawn = written(drawn, "mix-draws")
    every = F.sum("taken").over(Window.partitionBy())
    sized = drawn.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("taken") * (shards * blocks_per_shard) / F.greatest(every, F.lit(1)))).cast("long"))
    dealt = _dealt(sized.select("ordinal", "blocks"), shards, seed)
    plan = written(sized.join(dealt, "ordinal").select(
        F.col("source").alias("_s"), "words", "target", "times", "cut", "blocks", "shard_of"), "mix-plan")
    joined = keyed.join(lookup(plan, plan.count()), F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("times") + F.coalesce((F.col("h") <= F.col("cut")).cast("long"), F.lit(0))
    hashed = F.transform(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>")),
                         lambda c: F.md5(F.concat_ws("|", F.col("h"), c.cast("string"))))
    block = lambda h: F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32)) * F.col("blocks")).cast("int")
    draws = F.transform(hashed, lambda h: F.struct(F.element_at("shard_of", block(h) + 1).alias("shard"), F.substring(h, 9, 24).alias("place")))
    return joined.select("doc", "size", F.col("words").alias("source_words"), "target", draws.alias("draws"))


def mixed_rows(docs: DataFrame, shards: int | None = None, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per draw, dealt out by shard and shuffled inside it.

    A task sorts and writes a shard, so without a number of ``shards`` there is one for every ``SHARD_BYTES`` of text.
    """
    if shards is None:
        total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
        shards = max(SHARDS, -(-total // SHARD_BYTES))
    drawn = mix(docs, text_col=text_col, shards=shards, **options).select("doc", F.explode("draws").alias("_d"))
    return drawn.repartition(shards, F.col("_d.shard")).sortWithinPartitions("_d.shard", "_d.place").select("doc.*")


def mixing_digest(docs: DataFrame) -> DataFrame:
    mixed = mix(docs)
    return mixed.select(F.col("doc.doc_id").alias("doc_id"), "size", F.col("source_words").alias("source_size"), "target",
                        (F.col("size") * F.size("draws")).alias("taken"))


MIXING_SQL = r"""
WITH keyed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')) AS h FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS words FROM keyed GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
leveled AS (
  SELECT *, ((sum(words) OVER ())::DOUBLE - coalesce(sum(words * 3) OVER w, 0)::DOUBLE)
          / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER w, 0)::DOUBLE) AS level
  FROM weighed WINDOW w AS (ORDER BY words * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, words, least((words * 3)::DOUBLE, (max(level) OVER ()) * weight) AS target FROM leveled),
split AS (SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END::BIGINT AS times FROM goals),
placed AS (
  SELECT k.*, g.words, g.target, g.times, g.target - g.times * g.words AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY h)::BIGINT AS after,
         sum(size) OVER (PARTITION BY k.source, h)::BIGINT AS tied
  FROM keyed k JOIN split g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, words AS source_size, target,
       (size * (times + CASE WHEN rest > 0 AND after - tied / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed"""
