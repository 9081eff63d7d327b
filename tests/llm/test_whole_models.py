"""Models that leave nothing out: rare contexts of the suffix tree, and routes that do not change a score."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_llm_operators import small_tree
from zocalo.llm import suffix_tree
from zocalo.llm.simhash import words

RARE = 40


@pytest.fixture(scope="module")
def mixed(spark):
    """Much text of one kind, and a source of 40 documents whose words come some twenty times each."""
    rng = np.random.default_rng(5)
    draw = lambda letters, n: ["".join(rng.choice(list(letters), 7)) for _ in range(n)]
    common, rare = draw("abcdefghijklmnop", 300), draw("qrstuvwxyz", 100)
    rows = [(i, " ".join(rng.choice(rare, 50))) for i in range(RARE)]
    rows += [(RARE + i, " ".join(rng.choice(common, 1500))) for i in range(500)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


@pytest.mark.parametrize("held", [suffix_tree.COMMON_GRAMS, 2000])
def test_scores_equal_the_whole_tree(mixed, held):
    rows, table = mixed
    texts = {i: suffix_tree.canonical(words(t)) for i, t in rows}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sum(map(len, train)) > 5_000_000  # a word of the rare source has less than 5e-6 of that
    tree = small_tree(train, suffix_tree.LEAST_GAIN)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.lm_scores(table, held).collect()}
    some = list(range(RARE + 20))
    assert [got[i] for i in some] == pytest.approx(tree.scores([texts[i] for i in some]).tolist(), rel=2e-4)


def test_no_bound_on_contexts(spark):
    """Of two trees of the same texts, table and memory, both keep whatever diverges: far more contexts than a fixed number."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(30000)]
    texts = [" ".join(vocabulary[i] for i in rng.permutation(30000)).encode() + b"\n" for _ in range(6)]
    tree = small_tree(texts, suffix_tree.LEAST_GAIN)
    assert len(tree.step) > 100_000
    key, n = np.unique(np.concatenate([suffix_tree.gram_keys(d, v) for d, v, _, _ in suffix_tree.streams(texts)]), return_counts=True)
    found = suffix_tree.gram_scores(spark.createDataFrame(pa.table({"key": key, "n": n}))).toArrow()
    score = dict(zip(found.column("key").to_pylist(), found.column("score").to_pylist()))
    text = texts[0][:5000]
    own = np.concatenate([suffix_tree.gram_keys(d, v) for d, v, _, _ in suffix_tree.streams([text])])
    assert sum(score[k] for k in own.tolist()) == pytest.approx(tree.scores([text])[0], rel=2e-4)


@pytest.fixture(scope="module")
def many_grams():
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(2000)]
    texts = [" ".join(vocabulary[i] for i in rng.integers(0, 2000, 5000)).encode() + b"\n" for _ in range(6)]
    key, n = np.unique(np.concatenate([suffix_tree.gram_keys(d, v) for d, v, _, _ in suffix_tree.streams(texts)]), return_counts=True)
    return texts, key, n


def test_the_tree_is_written_once(spark, many_grams, monkeypatch):
    """A table as long as the grams for every context length took more disk than four times the input."""
    _, key, n = many_grams
    kept, written = suffix_tree.stored, []
    monkeypatch.setattr(suffix_tree, "stored", lambda df, name: written.append(kept(df, name)) or written[-1])
    assert suffix_tree.gram_scores(spark.createDataFrame(pa.table({"key": key, "n": n}))).count() == len(key)
    assert sum(t.count() for t in written) < 1.5 * len(key)


def test_endings_that_go_on_in_the_next_batch(spark, many_grams, monkeypatch):
    texts, key, n = many_grams
    monkeypatch.setattr(suffix_tree, "PART", 150)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        # more than a batch and a part of one ending, and grams that no text learned from has
        more = np.array([int.from_bytes(b"abc" + b"qqq" + bytes([x])) for x in range(11, 250)])
        table = pa.table({"key": np.append(key, more), "n": np.append(n, np.zeros(len(more), np.int64))})
        found = suffix_tree.gram_scores(spark.createDataFrame(table)).toArrow()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    score = dict(zip(found.column("key").to_pylist(), found.column("score").to_pylist()))
    assert len(score) == found.num_rows == len(key) + len(more)
    tree = small_tree(texts, suffix_tree.LEAST_GAIN)
    own = np.concatenate([suffix_tree.gram_keys(d, v) for d, v, _, _ in suffix_tree.streams(texts[:1])])
    assert sum(score[k] for k in own.tolist()) == pytest.approx(tree.scores(texts[:1])[0], rel=2e-4)
