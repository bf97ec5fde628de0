"""The language model's counts and ids of odd texts against plain Python, and what they take."""

import pickle
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import maxent

TEXTS = [
    "One two\ttwo\x0bthree\x0cTHREE\r\nthree", "", None, " \n ", "  ends in space \t", "a\x1cb \x85 c d  ", "ÉTÉ été İſ K",
    "x\x00y \U0001f600\U0001f601\U0001f602", "z", "un" * 40 + " two " * 300, *(f"new{k} two" for k in range(20)),
]


def _plain(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in low.encode().split()] + [maxent.END]


def _docs(spark):
    rows = [(None if k == 4 else k, t) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)


@pytest.mark.parametrize("most", [5, 300_000])
def test_counts_of_odd_texts_are_those_of_plain_python(spark, most):
    got = [(r.token, r.c) for r in maxent.token_counts(_docs(spark), most).collect()]
    assert len(got) == len(dict(got)) and dict(got) == Counter(w for t in TEXTS for w in _plain(t))


@pytest.mark.parametrize(("known", "most"), [(0, 1), (8, 60), (10_000, 1 << 23)])
def test_ids_of_odd_texts_are_those_of_plain_python_in_three_bytes(spark, known, most):
    docs = _docs(spark)
    vocab = maxent.vocabulary(maxent.cut(maxent.token_counts(docs)), known)
    rows = maxent.encode(docs, F.col("doc_id") != 3, vocab, most).collect()
    assert len({r.key for r in rows}) == len(TEXTS) and [r.doc_id for r in rows] == [None if k == 4 else k for k in range(len(TEXTS))]
    assert [r.train for r in rows] == [k not in (3, 4) for k in range(len(TEXTS))]
    for r, t in zip(rows, TEXTS, strict=True):
        ws = _plain(t)
        assert maxent._ids([r.ids]).tolist() == [vocab.index.get(w.encode(), -1 - maxent._tail(w)) for w in ws]
        assert r.rest == [w for w in ws if w.encode() not in vocab.index] and len(r.ids) == 3 * len(ws)


def test_ids_of_24_bits_come_back():
    x = np.array([0, 1, -1, -48, 4095, 65_535, 65_536, 149_999, -(1 << 23), (1 << 23) - 1], dtype=np.int32)
    assert maxent._ids(maxent._packed(x, np.array([0, 4, 4, len(x)]))).tolist() == x.tolist()


def test_a_vocabulary_travels_without_its_index():
    vocab = maxent.Vocabulary(["\n", "a"], np.array([3, 2]), 5, 2, np.zeros(maxent.TAIL_CLASSES))
    assert vocab.index == {b"\n": 0, b"a": 1}
    again = pickle.loads(pickle.dumps(vocab))
    assert "index" not in vars(again) and again.index == vocab.index


@pytest.mark.parametrize("meet", [1, 7, 64, 100_000])
def test_a_step_adds_up_rows_of_few_and_of_many_positions(meet):
    rng = np.random.default_rng(meet)
    vocab = maxent.Vocabulary(["\n", "a"], np.array([3, 2]), 5, 100_000, np.zeros(maxent.TAIL_CLASSES))
    t, start = maxent.Trainer(maxent.initial(vocab)), maxent.initial(vocab)
    for level, width in enumerate(maxent.WIDTHS):
        rows = np.minimum(rng.integers(0, len(start.rows[level]), (4, 777)), rng.integers(0, meet, (4, 777)))
        grad = rng.normal(size=(777, width)).astype(np.float32)
        t._step(level, rows, grad)
        sums = np.zeros(start.rows[level].shape)
        for r in rows:
            np.add.at(sums, r, grad)
        step = maxent.RATE / np.sqrt(1 + (sums**2).mean(axis=1))
        assert t.w.rows[level] == pytest.approx(-step[:, None] * sums, abs=1e-4)
        assert (t.touched[level] == np.bincount(rows.ravel(), minlength=len(sums))).all()
