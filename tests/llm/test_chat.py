"""Chat formatting against a parser and a renderer in plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from kinfold.llm import chat, queries

PARTS = ["### User: ", "### Assistant: ", "### System: ", "### x-41: ", "</turn>", "\n</turn>\n", "\n", "\\", "\\\\", "###", "### ", "User: ", "</", "turn>", "a", " ", "é", "\U0001F600", "$1", "#"]
ROLES = ["user", "assistant", "system", "tool", "User", "", None, "a: b\n</turn>\n### User: ", "x-41"]


def read(formatted):
    """A parser that looks for marks one after the other, unlike the one tested."""
    turns, at = [], 0
    while at < len(formatted):
        head = re.compile(r"### (System|User|Assistant|x-(?:[0-9A-F]{2})*): ").match(formatted, at)
        end = formatted.index("\n</turn>\n", head.end())
        label = head.group(1)
        role = bytes.fromhex(label[2:]).decode() if label.startswith("x-") else label.lower()
        turns.append((role, re.sub(rf"\\(\\*)({chat.CONTROL})", r"\1\2", formatted[head.end() : end])))
        at = end + len("\n</turn>\n")
    return turns


def rows_of(seed, n=120):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(ROLES), rng.choice([None, "", *["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 9))) for _ in range(6)]])) for c in range(n) for t in range(rng.randrange(1, 6))]
    return rows + rows[:5] + [(None, 1, "user", "lost"), (None, None, "user", "no turn"), (500, 1, "user", "b"), (500, 1, "user", "a"), (501, 0, "assistant", chat.PROBE_TEXT)]


def test_round_trip(spark):
    clash = {c: F.lit("clash") for c in ("shown", "source", "turns", "formatted", "label", "body", "said")}
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(clash).repartition(4)
    formatted = chat.format_conversations(df)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or ""))
    digests = {r.conv_id: r for r in chat.digests(formatted).collect()}
    seen = formatted.collect()
    assert {r.conv_id for r in seen} == {r[0] for r in rows}
    for r in seen:
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=key)]
        assert read(r.formatted) == want == [(t.role, t.text) for t in r.turns]
        at, learned = 0, []
        for t in r.turns:
            at += t.masked
            if t.role == "assistant":
                learned.append(r.formatted[at : at + t.learned])
            at += t.learned
        assert at + len("\n</turn>\n") == len(r.formatted)
        loss, d = "".join(x[1] for x in want if x[0] == "assistant"), digests[r.conv_id]
        assert "".join(re.sub(rf"\\(\\*)({chat.CONTROL})", r"\1\2", x) for x in learned) == loss
        said = "".join(f"{a}\n{b}\n" for a, b in want)
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(want), len(loss), len(r.formatted))
        assert (d.turns_sha256, d.loss_sha256) == (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())


def test_only_conflicting_texts_change(spark):
    texts = ["plain", "### User of", "a \\ b", "</turn", "see ### User: x", "\\</turn>", "ends in \\", "ends in </turn>"]
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert [got[i] != f"### User: {t}\n</turn>\n" for i, t in enumerate(texts)] == [False] * 4 + [True, True, False, True]
    assert got[5] == "### User: \\\\</turn>\n</turn>\n"


def test_a_broken_grammar_is_seen(spark):
    parsed = spark.sql(r"select explode(array('### User: a', 'b\n</turn>\n', '### User: x </turn> y\n</turn>\n', '### Root: x\n</turn>\n', '')) t").select(chat.parse(F.col("t")).alias("p"))
    rows = [r.p for r in parsed.collect()]
    assert [[t.role for t in p] for p in rows] == [["user"], [None], [None], [None], []]


def test_probe_empty_and_long(spark, sf):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty).count() == 0
    assert [r.conv_id for r in chat.digests(chat.format_conversations(chat.with_probe(empty))).collect()] == [-7]
    probe = queries.op13_chat_format(spark, sf).where("conv_id = -7").first()
    assert (probe.n_turns, probe.loss_chars) == (2, len(r"\### Assistant: </turn> ok"))
    long = spark.range(4000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("</turn> " * 50).alias("text"))
    assert chat.digests(chat.format_conversations(long)).first().loss_chars == 4000 * 400
