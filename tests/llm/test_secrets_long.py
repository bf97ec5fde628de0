"""Texts with very many matches."""

import time

from kinfold.llm import secrets


def test_spans_of_a_hundred_thousand_matches(spark):
    """Positions are right in every chunk, and twice the matches take about twice the time."""
    words = [f"token={i:08d}x deadbeefdeadbeefdeadbeef{i:x}" if i % 3 else f"é token=ab {i}" for i in range(100_000)]
    took = []
    for n in (50_000, 100_000):
        text = " ".join(words[:n])
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        spans = secrets.by_path(df, secrets.scan(df)[1]).first().spans
        took.append(time.time() - began)
        at, want = 0, []
        for i, w in enumerate(words[:n]):
            if i % 3:
                want.append((at, 0, at + w.index(" ")))
                want.append((at + w.index(" ") + 1, 2, at + len(w)))
            at += len(w) + 1
        assert [(s.start, s.kind, s.end) for s in spans] == want
    assert took[1] < 4 * took[0] + 10
