"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

log P(token | history) is a sum of softmaxes. The HEAD most frequent tokens are leaves of a tree of 16 x 16 x 16, in
order of their spelling from the end, so that a class holds alike endings: P(class), P(subclass | class), P(token |
subclass), each given the history. All other tokens are one more outcome of the first level, the tail; they lie in TAIL_CLASSES
classes by the hash of their last two characters, P(tail class | tail, history), and have within it the add-one share of their
count, unseen ones a single further place; so a history's probabilities sum to one. The features of a history are the last token,
the last two, and the skips: the second last token and, at the first level and the tail's, the third last; each is hashed to a
row of weights, together with the level and the parent.

Counts run over all training tokens. Every training position is learned from once. Texts are dealt into shards by the hash
of their id and their text, shards into ROUNDS; in a round each shard takes minibatch gradient steps (AdaGrad) from the round's
start, and the next round starts from the average of their weights, row by row, by the positions that touched a row.
Shards follow from the counts and the rows alone, so partitions don't change the result. Averages are summed by block of
rows in a tree of bounded fan-in. A history touches a few rows only, and scoring works on numpy batches of them.

Counts of the KNOWN most frequent tokens are broadcast (the number and the length of a token are bounded); the rest of
the tokens, a small share, meet their counts in a join.

Defined results: null text is empty; an empty text has one token, the end; every row gives a row, repeated rows and null
ids too (a null id is never held out); without training rows all counts are 0 and the tail's unseen place has the whole
of its class; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, worker_cache

FAN = 16
HEAD, TAIL_CLASSES = FAN**3, 48
#: Outcomes of the levels: the first sixteenth of the head or else the tail (and one that never comes, as sums take two at a time), the
#: next two sixteenths of the head, the tail's class.
WIDTHS = (FAN + 2, FAN, FAN, TAIL_CLASSES)
TAIL = 3
KNOWN, LONGEST = 150_000, 48
#: Rows of weights of each level: as many as there are distinct tokens, between these.
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 15
BATCH, RATE, ROUNDS, FAN_IN, BLOCK = 4096, 0.15, 4, 16, 2048
#: Training tokens of a shard, and how many shards a round has at least and at most; beyond that shards grow.
SHARD_TOKENS, LEAST_SHARDS, MOST_SHARDS = 3_000_000, 2, 1024
#: The end of a text, which no word can be.
END = "\n"
_NONE = -(1 << 31)
#: How many of a row's positions a step adds to those of all rows at once; what few rows have left is summed row by row.
LAYERS = 8
#: Bounds of a score; e to their power, times the outcomes of a level, is a float32.
MOST_SCORE = 80.0


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts in lower case, and where each text's begin. White space at either end of a text leaves an empty
    piece, which is no word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    begin = lists.offsets.to_numpy()
    return lists.values.slice(begin[0], begin[-1] - begin[0]), begin - begin[0]


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have so many bytes at most (one text may have more)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def token_counts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """token, c over the texts of docs, the ends counted too. Tasks count ahead of the shuffle, up to `most` tokens at a time."""

    def counted(rows: pa.RecordBatch) -> pa.Table:
        got = pc.value_counts(_pieces(rows.column("text"))[0])
        token, c = got.field("values"), got.field("counts")
        word = pc.not_equal(token, "")
        return pa.table({"token": pa.concat_arrays([token.filter(word), pa.array([END], token.type)]), "c": pa.concat_arrays([c.filter(word), pa.array([len(rows)], c.type)])})

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("c", "sum")]).rename_columns(["token", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("maxent")  # drops those of other operators
        held: list[pa.Table] = []
        for batch in batches:
            for part in _slices(batch, 1 << 22):
                held.append(counted(part))
                if sum(map(len, held)) > 2 * most:
                    held = [summed(held)]
                    if len(held[0]) > most:
                        yield from held.pop().to_batches(20_000)
        if held:
            yield from summed(held).to_batches(20_000)
        held.clear()
        release()

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _tail_class(token: Column) -> Column:
    return (F.crc32(F.right(token, F.lit(2)).cast("binary")) % TAIL_CLASSES).cast("int")


def _tail(token: str) -> int:
    return zlib.crc32(token[-2:].encode("utf-8", "replace")) % TAIL_CLASSES


@dataclass
class Vocabulary:
    """tokens by falling count, their counts, N, V, and the log10 of each tail class's places."""

    tokens: list[str]
    counts: np.ndarray
    n: int
    v: int
    tail_log: np.ndarray

    def __post_init__(self):
        self.tail_of = np.array([_tail(t) for t in self.tokens], dtype=np.int64)
        self.log_c1 = np.log10(self.counts + 1.0)
        head = sorted(range(min(HEAD, len(self.tokens))), key=lambda i: self.tokens[i][::-1])
        self.leaf = np.zeros(len(head), dtype=np.int64)
        self.leaf[head] = np.arange(len(head)) * HEAD // max(1, len(head))

    @cached_property
    def index(self) -> dict[bytes, int]:
        return {t.encode(): i for i, t in enumerate(self.tokens)}

    def __getstate__(self):
        return self.tokens, self.counts, self.n, self.v, self.tail_log

    def __setstate__(self, state):
        self.tokens, self.counts, self.n, self.v, self.tail_log = state
        self.__post_init__()


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """counts: a table that is cheap to read again. Buckets of the logarithm of the count, at most 64 * 16 of them, tell
    from which count on the tokens are few enough."""
    bucket = F.floor(F.log2("c") * 16).cast("int")
    short = F.char_length("token") <= LONGEST
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count(F.when(short, 1)).alias("k"), F.count("*").alias("v"), F.sum("c").alias("n")).collect()
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r.b):
        if total + r.k > known:
            break
        total, least = total + r.k, r.b
    rows = [] if least is None else counts.where((bucket >= least) & short).collect()
    rows = sorted(((r.c, r.token) for r in rows), key=lambda x: (x[1] != END, -x[0], x[1]))
    tails = {r.k: r.m for r in counts.groupBy(_tail_class(F.col("token")).alias("k")).agg(F.sum(F.col("c") + 1).alias("m")).collect()}
    places = np.array([tails.get(k, 0) + 1.0 for k in range(TAIL_CLASSES)])
    vocab = Vocabulary([t for _, t in rows], np.array([c for c, _ in rows], dtype=np.int64), sum(r.n for r in sizes), sum(r.v for r in sizes), np.zeros(TAIL_CLASSES))
    for k, c in zip(vocab.tail_of[:HEAD].tolist(), vocab.counts[:HEAD].tolist(), strict=True):
        places[k] -= c + 1
    vocab.tail_log = np.log10(places)
    return vocab


@dataclass
class Weights:
    """bias of each level's outcomes, by parent; rows of weights of each level, hashed by the features."""

    bias: list[np.ndarray]
    rows: list[np.ndarray]


def initial(vocab: Vocabulary) -> Weights:
    """Log shares of the counts as biases, no features yet."""
    leaves = np.zeros(HEAD)
    np.add.at(leaves, vocab.leaf, vocab.counts[: len(vocab.leaf)])
    tail = 10.0**vocab.tail_log
    first = np.concatenate([leaves.reshape(FAN, -1).sum(axis=1), [tail.sum(), 0]])
    free = np.zeros(HEAD, dtype=bool)
    free[vocab.leaf] = True  # leaves without a token get no share
    has = [np.concatenate([free.reshape(FAN, -1).any(axis=1), [True, False]])[None], free.reshape(FAN, FAN, FAN).any(axis=2), free.reshape(FAN * FAN, FAN), np.ones((1, TAIL_CLASSES), dtype=bool)]
    mass = [first[None], leaves.reshape(FAN, FAN, FAN).sum(axis=2), leaves.reshape(FAN * FAN, FAN), tail[None]]
    n = 1 << max(vocab.v - 1, 1).bit_length()
    n = min(max(n, LEAST_ROWS), MOST_ROWS)
    share = lambda m: np.log((m + 0.5) / (m + 0.5).sum(axis=1, keepdims=True))
    return Weights([np.where(h, share(m), -30.0).astype(np.float32) for h, m in zip(has, mass, strict=True)], [np.zeros((n, w), dtype=np.float32) for w in WIDTHS])


def _mixed(x: np.ndarray, rows: int) -> np.ndarray:
    """Rows that sums of multiplied features fall in; x is written over."""
    x &= 0x7FFFFFFFFFFF
    x ^= x >> 17
    x *= 0x27D4EB2F
    x >>= 13
    x &= rows - 1
    return x


class Batch:
    """The tokens of some texts in one array. ids: the place in the vocabulary, or -1 less the tail class of a token that
    it does not hold."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, vocab: Vocabulary):
        n_known = len(vocab.tokens)
        self.ids, self.length = ids, length
        self.owner = np.repeat(np.arange(len(length)), length)
        self.place = np.arange(len(ids)) - np.repeat(np.cumsum(length) - length, length)
        known = ids >= 0
        tail = np.where(known, 0, -1 - ids)
        tail[known] = vocab.tail_of[ids[known]]
        self.is_head = known & (ids < HEAD)
        leaf = np.zeros(len(ids), dtype=np.int64)
        leaf[self.is_head] = vocab.leaf[ids[self.is_head]]
        self.tail, self.leaf = tail, leaf
        none = np.zeros(len(ids), dtype=np.int64)
        self.target = np.where(self.is_head, leaf // (FAN * FAN), FAN), leaf // FAN % FAN, leaf % FAN, tail
        self.parent = none, leaf // (FAN * FAN), leaf // FAN, none
        seen, begin = np.where(known, ids, n_known - 1 - ids), n_known + TAIL_CLASSES
        self.back = []  # the last token of each history, the second and the third last
        for k in (1, 2, 3):
            w = np.full(len(ids), begin)
            w[k:] = np.where(self.place[k:] >= k, seen[:-k], begin)
            self.back.append(w)

    def at(self, level: int) -> np.ndarray:
        """The positions that a level tells apart."""
        return np.arange(len(self.ids)) if level == 0 else np.flatnonzero(self.is_head != (level == TAIL))

    def rows(self, level: int, at: np.ndarray, n: int) -> np.ndarray:
        """The rows of the histories before the positions, a line for each feature."""
        w1, w2, w3 = (w[at] * 0x9E3779B1 if level in (0, TAIL) or w is not self.back[2] else None for w in self.back)
        up = (self.parent[level][at] + 1) * (level * 0x165667B1) + 8 * level * 0xC2B2AE3D
        sums = [up + w1, up + w2, up + w1 + (self.back[1][at] + 1) * 0x85EBCA77] + ([up + w3] if w3 is not None else [])
        return np.stack([_mixed(x + k * 0xC2B2AE3D, n) for k, x in enumerate(sums)])


def _raised(w: Weights, b: Batch, level: int, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scores of each position's outcomes raised to powers of e, and their sums. The biases are logarithms of shares, so
    that scores lie well within the bounds that keep float32 from running over."""
    table, bias = w.rows[level], w.bias[level]
    z = np.take(table, rows[0], axis=0, mode="clip")
    more = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(table, r, axis=0, mode="clip", out=more)
    z += bias if len(bias) == 1 else np.take(bias, b.parent[level][at], axis=0, mode="clip", out=more)
    np.clip(z, -MOST_SCORE, MOST_SCORE, out=z)
    np.exp(z, out=z)
    return z, np.einsum("ij->i", z)


def log_prob(b: Batch, w: Weights, vocab: Vocabulary) -> np.ndarray:
    """log10 of each token's probability, less log10(c + 1) of the tokens that the vocabulary does not hold."""
    out = np.zeros(len(b.ids))
    for level in range(len(WIDTHS)):
        at = b.at(level)
        for lo in range(0, len(at), 4_096):
            i = at[lo : lo + 4_096]
            z, total = _raised(w, b, level, i, b.rows(level, i, len(w.rows[level])))
            out[i] += np.log(z[np.arange(len(i)), b.target[level][i]] / total)
    out /= np.log(10.0)
    low = np.flatnonzero(~b.is_head)
    out[low] -= vocab.tail_log[b.tail[low]]
    low = low[b.ids[low] >= 0]
    out[low] += vocab.log_c1[b.ids[low]]
    return out


def _put(table: np.ndarray, row: np.ndarray, values: np.ndarray) -> None:
    """table[row] = values, whole rows at a time."""
    whole = f"V{table.shape[1] * table.itemsize}"
    table.view(whole)[row] = values.view(whole)


class Trainer:
    """Gradient steps of one shard, from the round's start."""

    def __init__(self, start: Weights):
        self.w = Weights(start.bias, [x.copy() for x in start.rows])
        self.square = [np.ones(len(x), dtype=np.float32) for x in start.rows]
        self.touched = [np.zeros(len(x), dtype=np.float32) for x in start.rows]

    def learn(self, b: Batch) -> None:
        for level in range(len(WIDTHS)):
            at = b.at(level)
            for lo in range(0, len(at), BATCH):
                i = at[lo : lo + BATCH]
                rows = b.rows(level, i, len(self.w.rows[level]))
                grad, total = _raised(self.w, b, level, i, rows)
                grad *= (1 / total)[:, None]
                grad[np.arange(len(i)), b.target[level][i]] -= 1
                self._step(level, rows, grad)

    def _step(self, level: int, rows: np.ndarray, grad: np.ndarray) -> None:
        """One AdaGrad step; rows: (k, n), grad: (n, width), the same for each of the k rows of a position."""
        bits = (rows.shape[1] - 1).bit_length()
        both = (rows << bits | np.arange(rows.shape[1])).ravel().astype(np.uint64 if len(self.square[level]) >> 32 - bits else np.uint32)
        both.sort()
        of = both >> bits
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        n = np.diff(first, append=len(of))
        capped = np.minimum(n, LAYERS + 1)
        by = np.argsort(-capped.astype(np.int8), kind="stable")
        first, n = np.take(first, by), np.take(n, by)
        row, position = np.take(of, first).astype(np.int64), (both & ((1 << bits) - 1)).astype(np.int64)
        g = np.take(grad, np.take(position, first), axis=0, mode="clip")
        more = np.empty_like(g)
        beyond = len(n) - np.cumsum(np.bincount(capped, minlength=LAYERS + 2))  # rows that more than 0, 1, ... positions touch
        for k, c in enumerate(beyond[1:LAYERS].tolist(), 1):  # their second positions, their third ones
            g[:c] += np.take(grad, np.take(position, first[:c] + k), axis=0, mode="clip", out=more[:c])
        if c := int(beyond[LAYERS]):  # what the longest have left, two floats at a time
            left = n[:c] - LAYERS
            ends = np.cumsum(left)
            of_left = np.take(position, np.arange(ends[-1]) + np.repeat(first[:c] + LAYERS - ends + left, left))
            g[:c] += np.add.reduceat(np.take(grad, of_left, axis=0, mode="clip").view(np.complex64), ends - left, axis=0).view(np.float32)
        square = self.square[level][row] + np.square(g, out=more) @ np.full(g.shape[1], 1 / g.shape[1], dtype=np.float32)
        self.square[level][row] = square
        self.touched[level][row] += n
        g *= (RATE / np.sqrt(square))[:, None]
        table = self.w.rows[level]
        _put(table, row, np.subtract(np.take(table, row, axis=0, mode="clip", out=more), g, out=g))

    def blocks(self, shard: int) -> pd.DataFrame:
        """The touched rows' weights times their positions, and these, by blocks of BLOCK rows."""
        out = []
        for level, (x, t) in enumerate(zip(self.w.rows, self.touched, strict=True)):
            for k in range(0, len(x), BLOCK):
                part = t[k : k + BLOCK]
                if part.any():
                    out.append((level, k, shard, np.hstack([x[k : k + BLOCK] * part[:, None], part[:, None]]).astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["level", "block", "shard", "sums"])


def _packed(ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Each text's ids: the low 16 bits of all, then the next 8."""
    low, high = ids.astype(np.uint16).tobytes(), (ids >> 16).astype(np.int8).tobytes()
    return [low[2 * a : 2 * b] + high[a:b] for a, b in pairwise(begin.tolist())]


def encode(docs: DataFrame, training: Column, vocab: Vocabulary, most: int = 1 << 23) -> DataFrame:
    """key (of the row), doc_id, train, deal (the hash that deals the row to a shard), the ids (of Batch) as the bytes of
    _packed, and rest, the tokens that the vocabulary does not hold. most: bytes of texts that a task looks up at a time."""
    if len(vocab.tokens) > 1 << 23:
        raise ValueError("ids have 24 bits")
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = "key long, doc_id long, train boolean, deal long, ids binary, rest array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value.tokens, pa.string())
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in _slices(batch, most):
                piece, begin = _pieces(part.column("text"))
                word = np.append(pc.binary_length(piece).to_numpy() > 0, True)
                piece = pa.concat_arrays([piece, pa.array([END], piece.type)])
                after = np.cumsum(np.diff(np.append(0, np.cumsum(word))[begin]) + 1)  # behind each text's end
                source = np.full(after[-1], len(piece) - 1)
                inner = np.ones(len(source), dtype=bool)
                inner[after - 1] = False
                source[inner] = np.flatnonzero(word[:-1])
                ids = np.take(pc.fill_null(pc.index_in(piece, value_set=known.cast(piece.type)), _NONE).to_numpy(), source)
                at = np.flatnonzero(ids == _NONE)
                rest = piece.take(pa.array(source[at]))
                last = pc.utf8_slice_codeunits(rest, -2).dictionary_encode()
                ids[at] = -1 - np.array([_tail(x) for x in last.dictionary.to_pylist()], dtype=np.int32)[last.indices.to_numpy()]
                after = np.append(0, after)
                yield pa.record_batch({
                    "key": pa.array(np.arange(key, key + len(part))), "doc_id": part.column("doc_id"), "train": part.column("train"), "deal": part.column("deal"),
                    "ids": pa.array(_packed(ids, after), pa.binary()),
                    "rest": pa.ListArray.from_arrays(pa.array(np.searchsorted(at, after), pa.int32()), rest),
                })
                key += len(part)
        release()

    deal = F.xxhash64("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("train"), deal.alias("deal"), "text")
    return rows.mapInArrow(run, schema)


def _ids(packed: list[bytes]) -> np.ndarray:
    ids = np.frombuffer(b"".join(x[len(x) // 3 * 2 :] for x in packed), dtype=np.int8).astype(np.int64) << 16
    ids |= np.frombuffer(b"".join(x[: len(x) // 3 * 2] for x in packed), dtype=np.uint16)
    return ids


def _batches(pdf: pd.DataFrame, vocab: Vocabulary, most: int = 200_000) -> Iterator[tuple[slice, Batch]]:
    """Batches of some tokens (one text may have more), with the rows that they cover."""
    packed = pdf["ids"].tolist()
    length = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 3
    lo = held = 0
    for i, n in enumerate(length.tolist(), 1):
        held += n
        if held >= most or i == len(packed):
            yield slice(lo, i), Batch(_ids(packed[lo:i]), length[lo:i], vocab)
            lo, held = i, 0


def _summed(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(g["sums"].iloc[0]) // 4)
    for x in g.sort_values("shard")["sums"]:
        total += np.frombuffer(x, dtype=np.float32)
    return pd.DataFrame({"level": [key[0]], "block": [key[1]], "shard": [key[2]], "sums": [total.astype(np.float32).tobytes()]})


def _dealt_evenly(spark: SparkSession, n: int) -> list[int]:
    """n numbers that Spark's hash deals to n different partitions."""
    at = F.pmod(F.hash("id"), F.lit(n))
    return [r.id for r in spark.range(n * 64).groupBy(at.alias("part")).agg(F.min("id").alias("id")).orderBy("part").collect()]


def train(encoded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> Weights:
    """One pass over the training rows of encoded, in rounds."""
    w, sc = initial(vocab), encoded.sparkSession.sparkContext
    if not vocab.n:
        return w
    shards = min(max(vocab.n // (shard_tokens * rounds), LEAST_SHARDS), MOST_SHARDS)
    columns = "level int, block int, shard int, sums binary"
    spread = F.array(*[F.lit(x) for x in _dealt_evenly(encoded.sparkSession, shards)])
    dealt = encoded.where("train").select(F.pmod("deal", F.lit(rounds)).alias("round"), F.pmod(F.shiftright("deal", 20), F.lit(shards)).cast("int").alias("shard"), "doc_id", "deal", "ids")
    for k in range(rounds):
        shared = sc.broadcast((vocab, w))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            v, start = shared.value
            shard, trainer = None, None
            for pdf in batches:
                for own, part in pdf.groupby("shard", sort=False):
                    if own != shard:
                        if trainer is not None:
                            yield trainer.blocks(shard)
                        shard, trainer = own, Trainer(start)
                    for _, b in _batches(part, v):
                        trainer.learn(b)
            if trainer is not None:
                yield trainer.blocks(shard)

        rows = dealt.where(F.col("round") == k).repartition(shards, F.coalesce(F.get(spread, F.col("shard")), F.col("shard").cast("long"))).sortWithinPartitions("shard", "doc_id", "deal")
        sums = cut(rows.select("shard", "ids").mapInPandas(run, columns))
        n = shards
        while n > 1:  # no task adds up more than FAN_IN blocks
            sums = sums.groupBy("level", "block", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")).applyInPandas(_summed, columns)
            n = -(-n // FAN_IN)
        after = Weights(w.bias, [x.copy() for x in w.rows])
        for r in sums.collect():
            width = WIDTHS[r.level]
            x = np.frombuffer(r.sums, dtype=np.float32).reshape(-1, width + 1)
            hit = x[:, -1] > 0
            after.rows[r.level][r.block : r.block + BLOCK][hit] = x[hit, :-1] / x[hit, -1:]
        w = after
        shared.destroy()
    return w


def score(encoded: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: Weights) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score. counts: all tokens and their counts."""
    shared = encoded.sparkSession.sparkContext.broadcast((vocab, weights))
    schema = "key long, doc_id long, n_tokens long, n_known long, base double, lm double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, w = shared.value
        for pdf in batches:
            for at, b in _batches(pdf, v):
                known, n = np.flatnonzero(b.ids >= 0), len(b.length)
                yield pd.DataFrame({
                    "key": pdf["key"].array[at], "doc_id": pdf["doc_id"].array[at], "n_tokens": b.length, "n_known": np.bincount(b.owner[known], minlength=n),
                    "base": np.bincount(b.owner[known], v.log_c1[b.ids[known]], minlength=n), "lm": np.bincount(b.owner, log_prob(b, w, v), minlength=n),
                })

    part = encoded.select("key", "doc_id", "ids").mapInPandas(run, schema)
    rest = encoded.select("key", F.explode("rest").alias("token")).join(counts, "token")
    rest = rest.groupBy("key").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("c") + 1)).alias("s"))
    places = float(np.log10(vocab.n + vocab.v + 1))
    s = F.coalesce("s", F.lit(0.0))
    return part.join(rest, "key", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + s - F.col("n_tokens") * places).alias("base_score"), (F.col("lm") + s).alias("score"),
    )


def fit_and_score(docs: DataFrame, training: Column) -> DataFrame:
    """Learns from the rows where training holds and scores all rows."""
    counts = cut(token_counts(docs.where(training)))
    vocab = vocabulary(counts)
    encoded = cut(encode(docs, training, vocab))
    return score(encoded, counts, vocab, train(encoded, vocab))
