"""Token counts: round trips through flat files with boundaries everywhere."""

import numpy as np
import pytest

from ingestkit.llm import token_scan as T


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_raw_files(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(T, "RUN", 3)
    rng = np.random.default_rng(block)
    want = []
    for name in ("a", "b", "c", "d", "e"):
        lengths = [] if name == "c" else rng.integers(0, 12, 20).tolist() if name != "d" else [0, 0, 90, 0]
        flat = [t for n in lengths for t in [*rng.integers(0, 50_000, n), T.SEPARATOR]]
        tail = {"b": 5, "c": 3}.get(name, 0)
        np.array(flat + [7] * tail, "<u2").tofile(tmp_path / name)
        want += [(name, k, n, True) for k, n in enumerate(lengths)] + ([(name, len(lengths), tail, False)] if tail else [])
    (tmp_path / "empty").touch()
    got = T.count(T.read_files(spark, f"file://{tmp_path}", block=block)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.n_tokens, r.finished) for r in got) == want


def test_files_are_not_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "RUN", 4)
    lengths = [700, 0, 5_000, 1]
    flat = [t for n in lengths for t in [*[7] * n, T.SEPARATOR]] + [7] * 33
    np.array(flat, "<u2").tofile(tmp_path / "a b%20é")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # a file that Spark refuses to hand over
    try:
        blocks = T.read_files(spark, f"file://{tmp_path}", block=64)
        assert blocks.rdd.getNumPartitions() == -(-len(flat) // (64 * 4)) and "content" not in blocks._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.ordinal, r.n_tokens, r.finished) for r in T.count(blocks).collect())
        own = T.read_files(spark, f"file://{tmp_path}", block=64, opened=lambda p: open(p.removeprefix("file:"), "rb"))
        assert sum(len(r.tokens) for r in own.collect()) == 2 * len(flat)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == [(k, n, True) for k, n in enumerate(lengths)] + [(4, 33, False)]


@pytest.mark.parametrize("raw", [True, False])
def test_documents(spark, monkeypatch, raw):
    """Counted in raw files where tasks can open the shared folder, else in rows of blocks."""
    if raw:
        monkeypatch.setattr(T, "write_tokens", None)
    else:
        monkeypatch.setattr(T, "local_folder", lambda *_: None)
    rows = [(k, "word " * (k * 13 % 50) + "é漢", "x", 1) for k in range(60)] + [(100, None, "x", 1), (101, "", "x", 1), (102, "<|endoftext|> is text", "x", 1),
                                                                              (None, "no id", "x", 1), (5, "again", "x", 1), (5, "again", "x", 1), (103, "long " * 40_000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, n_tokens int").repartition(3)
    encode = T.encoder(open(T.TOKENIZER, "rb").read()).encode_ordinary
    key = lambda x: str(x)
    got = sorted(((r.doc_id, r.n_tokens) for r in T.token_counts(docs).collect()), key=key)
    assert got == sorted(((i, len(encode(t or ""))) for i, t, _, _ in rows), key=key)
    assert T.token_counts(docs.limit(0)).count() == 0


def test_files_of_failed_attempts_count_for_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(k, "word " * k) for k in range(9)], "doc_id long, text string").repartition(2)
    folder = T.local_folder(spark, f"file://{tmp_path}/made")
    catalogue = T.write_files(docs, folder)
    (tmp_path / "made" / "00000000-999").write_bytes(np.arange(7, dtype="<u2").tobytes())
    blocks = T.count(T.read_files(spark, f"file:{folder}")).selectExpr("regexp_extract(file, '[^/]+$', 0) AS file", "ordinal", "n_tokens")
    named = catalogue.selectExpr("file", "first", "posexplode(ids) AS (k, doc_id)").selectExpr("file", "first + k AS ordinal", "doc_id")
    assert sorted(r.doc_id for r in named.join(blocks, ["file", "ordinal"]).collect()) == list(range(9))
