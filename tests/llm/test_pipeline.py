"""The pipeline: columns, effects of every stage, clean documents stay."""

import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from ingestkit.llm import decontaminate, language, mixing, ngram_join
from ingestkit.llm.common import arrow_rows, lean, written
from ingestkit.llm.queries import ORACLES, QUERIES
from tests.conftest import plan_of
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", "src1", 0), (10_002, "123 456", "en", "src1", 7), (None, "the of and to in that", "en", None, 5)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    out = [docs]
    for name, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), f"test-{name}"))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(s.columns == stages[0].columns for s in stages[:5]) and "shard" in stages[5].columns


def test_language_rejects_texts_without_one(stages):
    before, after = stages[0], stages[1]
    kept = Counter(r.doc_id for r in after.collect())
    judged = language.identify(before, spans=False).collect()
    assert kept == Counter(r.doc.doc_id for r in judged if r.lang_pred != "und" and r.score >= P.LEAST_SCORE)
    assert not {10_000, 10_001, 10_002} & set(kept) and len(kept) > 0.95 * before.count() - 8


def test_one_of_each_group_stays(stages):
    classes = ngram_join.join_digest(stages[1]).collect()
    assert Counter(r.doc_id for r in stages[2].collect() if r.doc_id is not None) == Counter({r.component_id for r in classes if r.component_id is not None and r.doc_id is not None})


def test_near_copies_above_four_fifths_go(spark):
    def jaccard(x, y):
        a, b = ({tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in (x, y))
        return len(a & b) / len(a | b)

    rows, want = [], set()
    for k, (size, more) in enumerate([(124, 30), (124, 29), (104, 26), (104, 25), (104, 24)]):  # 120 and 100 runs, and as many more
        base = " ".join(f"w{k}x{n}" for n in range(size))
        longer = base + "".join(f" more{k}x{n}" for n in range(more))
        rows += [(2 * k, base, "en", "s", 1), (2 * k + 1, longer, "en", "s", 1)]
        want |= {2 * k} if jaccard(base, longer) >= 0.8 else {2 * k, 2 * k + 1}
    words = [f"v{n}" for n in range(480)]
    rows += [(20, " ".join(words), "en", "s", 1), (21, " ".join("changed" + w if n % 47 == 20 else w for n, w in enumerate(words)), "en", "s", 1),
             (22, " ".join(f"u{n}" for n in range(480)), "en", "s", 1), (23, " ".join(f"changedu{n}" if n % 40 == 20 else f"u{n}" for n in range(480)), "en", "s", 1)]
    assert jaccard(rows[-4][1], rows[-3][1]) >= 0.8 > jaccard(rows[-2][1], rows[-1][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()) == sorted(want | {20, 22, 23})


def test_ids_that_repeat_or_are_null(spark):
    text = [" ".join(f"t{k}x{n}" for n in range(120)) for k in range(6)]
    near = [t + " and one more" for t in text]
    rows = [(5, text[0]), (5, text[1]), (5, text[1]), (6, near[0]), (4, near[2]), (5, text[2]), (None, text[3]), (None, near[3]), (None, text[3]), (None, text[4]),
            (None, near[5]), (9, text[5]), (7, ""), (7, ""), (7, None), (None, ""), (5, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, "").collect()]
    loose = [t for i, t in got if i is None and t in (text[3], near[3])]
    assert len(loose) == 1
    want = [(5, text[0]), (5, text[1]), (4, near[2]), (None, loose[0]), (None, text[4]), (9, text[5]), (7, ""), (7, None), (None, ""), (5, " ")]
    assert Counter(got) == Counter(want)


def test_whole_texts_meet_the_winners_without_python(spark):
    """Equal rows and rows that differ in other columns, or in texts of one set: one stays, whatever the text's length."""
    text = " ".join(f"t{n}" for n in range(60))
    rows = [(3, text, "en", "a", 1), (3, text, "en", "a", 1), (3, text, "en", "b", 1), (3, text.upper(), "en", "a", 1), (4, text, "en", "a", 1), (5, "one two", None, None, None)]
    kept = P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, _row string, n_chars int"), "")
    assert "MapInArrow" not in plan_of(kept) and kept.columns == ["doc_id", "text", "lang", "_row", "n_chars"]
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == [3, 5] and {r.text.lower() for r in got} == {text, "one two"}


def test_contaminated_go(spark, stages, sf_dir):
    judged = decontaminate.decontaminate_digest(stages[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    assert Counter(r.doc_id for r in stages[3].collect()) == Counter(r.doc_id for r in judged if not r.contaminated)


def test_the_mix_takes_effect(stages):
    want = Counter()
    for r in mixing.mixing_digest(stages[3]).collect():
        want[r.doc_id] += r.taken // r.size if r.size else 0
    got = Counter(r.doc_id for r in stages[4].where("text IS NOT NULL").collect())
    assert {k: v for k, v in got.items() if want[k]} == {k: v for k, v in want.items() if v}


def test_all_rows_are_sharded(stages):
    assert Counter(r.doc_id for r in stages[5].collect()) == Counter(r.doc_id for r in stages[4].collect())


def test_run(spark, sf_dir):
    assert set(P.run(spark, sf_dir).columns) >= {"doc_id", "shard", "slot"} and entry.queries()["pipeline"] is P.run


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), QUERIES[name], ORACLES[name], sf_dir) is None


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_texts_move_in_small_batches_when_a_stage_is_run_later(spark, sf_dir, stage):
    sizes = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(s, None) for s in sizes]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    try:
        for own, wanted in (([None, None], ["512", "512"]), (["300", "2000"], ["300", "2000"])):
            for name, value in zip(sizes, own):
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)
            stage(spark, docs, sf_dir)
            assert [spark.conf.get(s) for s in sizes] == wanted
        spark.conf.unset(sizes[0])
        with arrow_rows(spark):
            assert spark.conf.get(sizes[0]) == "512"
        assert spark.conf.get(sizes[0], None) is None
    finally:
        for name, value in zip(sizes, before):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_kept_worker_gives_back_what_a_step_has_freed():
    def held():
        return int(re.search(r"\nAnonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1])

    seen = []

    def step(batches):
        for batch in batches:
            many = [bytes(1000) for _ in range(100_000)]
            pins = many[::2000]  # so that the end of the heap stays in use
            del many
            seen.append(held())
            yield batch
        pinned.extend(pins)

    pinned: list[bytes] = []
    assert list(lean(step)(iter([1, 2]))) == [1, 2] and len(pinned) == 50
    assert held() < seen[-1] - 50_000
