"""Byte-level BPE encoding and decoding.

Each match of the pre-split pattern is encoded by itself. Over its byte positions stands a segment tree
whose nodes hold the least pair rank below them and, of equal ranks, the leftmost position. A merge takes
the root, joins the pair and updates the leaves of the joined position, its left neighbour and the position
that died: a logarithmic number of nodes each. Short pieces go through the same trees in numpy, a batch of
pieces at a time; long ones one by one, where the tree saves the quadratic rescans.

Defined results: a null text counts as empty; an empty text has no ids and the digests of the empty string;
every row of the input gives one row (repeated rows too); further input columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, worker_cache

#: Pieces of up to so many bytes are merged in numpy batches.
SHORT = 32
#: Distinct pieces kept between batches by one Python worker; the cache is emptied when it is full.
CACHE_ENTRIES = 250_000
_NONE = np.int64(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairEncoder:
    """Encodes pieces by a rank file; the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, ids = [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ids.append(i)
        self.pair = dict(zip(keys, ids, strict=True))
        self.slots = 1 << max(4, (4 * len(keys)).bit_length())
        self.table_key = np.full(self.slots, -1, dtype=np.int64)
        self.table_id = np.full(self.slots, _NONE, dtype=np.int64)
        left_key, left_id = np.array(keys, dtype=np.int64), np.array(ids, dtype=np.int64)
        at = self._slot(left_key)
        while len(left_key):  # open addressing: what finds its slot taken moves on by one
            free = self.table_key[at] < 0
            self.table_key[at[free]], self.table_id[at[free]] = left_key[free], left_id[free]
            lost = self.table_key[at] != left_key
            left_key, left_id, at = left_key[lost], left_id[lost], (at[lost] + 1) & (self.slots - 1)
        self.cache: dict[str, bytes] = {}  # pieces and their packed ids; a worker's tasks share it through encoder()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(0x9E3779B97F4A7C1)) >> np.int64(20)) & (self.slots - 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, _NONE where it makes no token or an id is -1."""
        key = np.where((a < 0) | (b < 0), np.int64(-2), a << 20 | b)
        out, at = np.full(len(key), _NONE, dtype=np.int64), self._slot(key)
        open_ = np.flatnonzero(key >= 0)
        while len(open_):
            found = self.table_key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.table_id[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & (self.slots - 1)
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece through a segment tree of its own."""
        n = len(piece)
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        size = 1 << max(0, (n - 1).bit_length())
        none, get = int(_NONE) << 32, self.pair.get
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = get(ids[i] << 20 | ids[i + 1])
            if r is not None:
                tree[size + i] = r << 32 | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def update(i: int) -> None:
            j = after[i] if ids[i] >= 0 else n
            r = get(ids[i] << 20 | ids[j]) if j < n else None
            k, v = size + i, none if r is None else r << 32 | i
            tree[k] = v
            while k > 1:
                k >>= 1
                v = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == v:
                    break
                tree[k] = v

        while tree[1] < none:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            ids[i], ids[j] = tree[1] >> 32, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            update(j)
            update(i)
            if before[i] >= 0:
                update(before[i])
        return [i for i in ids if i >= 0]

    def merge_short(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Pieces of up to size bytes (a power of two), one tree each, all trees in step."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(n, size)
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        ids = np.where(np.arange(size) < length[:, None], self.byte_id[raw], -1)
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)  # the end, a neighbour that never pairs
        tree = np.empty((n, 2 * size), dtype=np.int64)
        leaf = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size)
        tree[:, size:] = leaf * size + np.arange(size)
        low = size
        while low > 1:
            low >>= 1
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        none = _NONE * size
        live = np.flatnonzero(tree[:, 1] < none)

        def update(row: np.ndarray, i: np.ndarray, rank: np.ndarray) -> None:
            k = size + i
            tree[row, k] = rank * size + i
            while k[0] > 1:  # all leaves are as deep
                k = k >> 1
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

        while len(live):
            top = tree[live, 1]
            i = top % size
            j = after[live, i]
            far = after[live, j]
            ids[live, i], ids[live, j] = top // size, -1
            after[live, i] = far
            before[live, far] = i
            update(live, j, np.full(len(live), _NONE))
            update(live, i, self._rank(ids[live, i], ids[live, far]))
            left = before[live, i]
            some = left >= 0
            row, i, left = live[some], i[some], left[some]
            if len(row):
                update(row, left, self._rank(ids[row, left], ids[row, i]))
            live = live[tree[live, 1] < none]
        keep = ids[:, :-1] >= 0
        flat, ends = ids[:, :-1][keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces into the cache."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for s in pieces:
            b = s.encode("utf-8", "replace")
            whole = self.ranks.get(b)
            if whole is not None:
                self.cache[s] = _packed([whole])
            elif len(b) > SHORT:
                self.cache[s] = _packed(self.merge_long(b))
            else:
                groups.setdefault(1 << (len(b) - 1).bit_length(), []).append((s, b))
        for size, members in groups.items():
            for at in range(0, len(members), 16_384):
                part = members[at : at + 16_384]
                for (s, _), got in zip(part, self.merge_short([b for _, b in part], size), strict=True):
                    self.cache[s] = _packed(got)

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        return (x.tolist() for x in self.packed_batch(texts))

    def packed_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text as int32, in blocks that bound what is held at once."""
        block: list[list[str]] = []
        held = 0
        for text in texts:
            block.append(self.split(text))
            held += len(block[-1])
            if held > 200_000:
                yield from self._block(block)
                block, held = [], 0
        yield from self._block(block)

    def _block(self, block: list[list[str]]) -> Iterator[np.ndarray]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        self.learn([p for p in set().union(*block) if p not in self.cache])
        cache = self.cache
        for pieces in block:
            yield np.frombuffer(b"".join(map(cache.__getitem__, pieces)), dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


_encoders: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(ranks_path: str, pattern: str) -> BytePairEncoder:
    """One encoder for each Python worker, with its cache, across batches and tasks."""
    key = (ranks_path, pattern)
    if key not in _encoders:
        _encoders[key] = BytePairEncoder(load_ranks(ranks_path), pattern)
    _encoders[key].cache = worker_cache(key)
    return _encoders[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int). The vocabulary file must be at the same path on every machine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks_path, pattern)
        for pdf in parts(batches):
            texts = pdf["text"].fillna("").tolist()
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "ids": pd.Series(list(enc.packed_batch(texts)), dtype=object)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) of a table of doc_id, ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks_path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "bytes": [enc.decode([] if x is None else x) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, bytes binary")


def encode_checked(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (whether the decoded ids are the text's bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks_path, pattern)
        for pdf in parts(batches):
            texts = pdf["text"].fillna("").tolist()
            ids = list(enc.packed_batch(texts))
            same = [enc.decode(x.tolist()) == t.encode("utf-8", "replace") for x, t in zip(ids, texts, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "ids": pd.Series(ids, dtype=object), "n_tokens": [len(x) for x in ids], "round_trip": same})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both ways in one pass, so that no id leaves Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks_path, pattern)
        name = {i: str(i) for i in enc.token}.__getitem__
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for pdf in parts(batches):
            rows = [(len(x), sha(" ".join(map(name, x)).encode()), sha(enc.decode(x))) for x in enc.encode_batch(pdf["text"].fillna("").tolist())]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
