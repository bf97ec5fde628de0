"""Alignment of tokenizers against a plain count of whole encodings."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import alignment, queries

A, B = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    (1, None), (2, ""), (3, " "), (4, " \n\t "), (5, "a▁b"), (6, "trailing space "), (7, "tab\tand\r\nlines\n\n next　wide no-break  x"), (8, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (9, "don't we'll I'M 'S"), (10, "\U0001F600\U0001F600 éé 中文字 ภาษา"), (11, "x" * 3000 + " " * 50 + "word " * 3000), (12, "same text here"), (12, "same text here"), (None, "no id"), (13, "a\x1cb \x00 c\x85d"), (14, "  two  spaces"), (15, "\nline"), (16, "if (x) {\n\treturn 1;\n}\n"),
]


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = alignment.byte_level()
    bytes_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], collections.Counter()
    for doc_id, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if not text or not (b"".join(map(bytes_a, x)) == b"".join(map(bytes_b, y)) == (" " + text).encode()):
            docs.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(bytes_a(i)) for i in x]).tolist(), np.cumsum([len(bytes_b(i)) for i in y]).tolist()
        links, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            links.append((x[i], y[j]))
            end = min(ends_a[i], ends_b[j])
            i, j = i + (ends_a[i] == end), j + (ends_b[j] == end)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            n, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, x[i:n])) + "|" + ",".join(map(str, y[j:m])))
            i, j = n, m
        docs.append((doc_id, x, y, links, groups))
        count.update(set(links))
    most = collections.Counter()
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for doc_id, x, y, links, groups in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((doc_id, len(x), len(y), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=repr), count, most


def found(df):
    return sorted((tuple(r) for r in df.select([c.split()[0] for c in alignment.RESULT.split(", ")]).collect()), key=repr)


def test_same_as_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(queries.op11_alignment(spark, sf)) == brute(rows)[0]


def test_odd_texts(spark, monkeypatch):
    rng = random.Random(1)
    rows = ODD + [(100 + i, "".join(rng.choice(["a", "The", " ", "  ", "\n", "\t", ".", "'s", "é", "12", "中", " ", "\x1f", "<", "▁" * (i % 7 == 0)]) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    clash = {c: F.lit("clash") for c in ("block", "seq", "stripe", "share", "order", "n", "a", "b", "m", "docs", "runs", "kind", "n_links", "best")}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(3)
    want, count, most = brute(rows)
    got, counts = alignment.align(df, A, B)
    assert found(got) == want
    stripes = alignment.tokenizers(A, B).stripes
    assert {(r.a, r.b): (r.n, r.best) for r in alignment.pair_counts(counts, stripes).collect()} == {p: (n, n == most[p[0]]) for p, n in count.items()}
    assert found(alignment.align(df.limit(0), A, B)[0]) == []


def test_small_blocks_and_shares(spark, sf, monkeypatch):
    """Stripes that are scored in many tasks, blocks of few texts and packed rows of few links change nothing."""
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    want = found(alignment.align(df, A, B)[0])
    for name, value in (("BLOCK_DOCS", 3), ("ROW_LINKS", 7), ("TASK_LINKS", 100), ("HELD_PAIRS", 50)):
        monkeypatch.setattr(alignment, name, value)
    assert found(alignment.align(df, A, B)[0]) == want


def test_units_cut_where_both_do():
    pair = alignment.Pair(A, B)
    assert pair.cuts
    rng = random.Random(2)
    for _ in range(2000):
        text = " " + "".join(rng.choice("ab. \n\t\r  '1") for _ in range(rng.randrange(0, 30)))
        units = alignment.UNIT.findall(text)
        assert "".join(units) == text and units == re.split(r"(?<=\S)(?=[ \n])", text)


@pytest.mark.parametrize("cuts", [True, False])
def test_whole_texts_and_units_agree(cuts):
    pair = alignment.Pair(A, B)
    pair.cuts = cuts
    texts = [t for _, t in ODD]
    rows, links = pair.block(texts)
    other = alignment.Pair(A, B)
    other.keep({})
    assert (rows, sorted(links)) == (other.block(texts)[0], sorted(other.block(texts)[1]))
