"""The language model tells tokens beyond the most frequent ones apart by their context."""

import numpy as np

from weftgraph.llm import lm


def test_words_of_a_group_depend_on_the_word_before(spark, monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 2)
    texts = [f"ka p{i % 20}" if i % 2 else f"kb q{i % 20}" for i in range(2000)]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(9000, "ka p1", False), (9001, "ka q2", False), (9002, "kb p1", False), (9003, "kb q2", False), (9004, "ka unseen", False)]
    got = {r.doc_id: r for r in lm.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), "train").collect()}
    assert got[9000].base_score == got[9001].base_score
    assert got[9000].score > got[9001].score + 1 and got[9003].score > got[9002].score + 1 and got[9004].score < got[9000].score


def test_vocabulary_grows():
    few, many = (lm.Vocabulary(10 * v, v, np.arange(3, dtype=np.uint64), np.ones(3, np.int64), 1) for v in (10_000, 1_000_000))
    assert many.size > 5 * few.size
    assert len(np.unique(many.classes(np.arange(100_000, dtype=np.uint64)))) > 240


def test_second_word_before_is_read():
    v = lm.Vocabulary(9, 3, np.array([5, 6, 7], np.uint64), np.array([1, 1, 1]), 1)
    now, first, second = v.read(np.array([5, 6, 7, lm._END, 6, lm._END], np.uint64), np.array([0, 0, 0, 0, 1, 1]))
    end = v.size - 1
    assert now.tolist() == [0, 1, 2, end, 1, end] and first.tolist() == [end, 0, 1, 2, end, 1] and second.tolist() == [end, end, 0, 1, end, end]


def test_group_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9, 5)).astype(np.float32)
    pair = np.unique(rng.integers(0, 40 * 9, 150))
    q, b, z = lm.train_group(pair // 9, pair % 9, rng.integers(1, 9, len(pair)).astype(np.float32), rng.integers(1, 9, 41).astype(float), x)
    assert np.allclose(np.exp(q @ x.T + b[:, None] - z).sum(axis=0), 1, atol=1e-4)
