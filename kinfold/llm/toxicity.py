"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words is the cosine of their gapped subsequences: every choice of ORDER letters, in order, within a
span of ORDER + MAX_GAP, weighs DECAY for each letter skipped. So "idxiot" or "i-d-i-o-t" stay near "idiot", where
letters are folded first (case, accents, digits that stand for letters, punctuation inside words, spelled-out words, and
neighbouring fragments of a sentence such as "id iot", which are read as one word too). Letters beyond a-z keep their
own codes; subsequences with such a letter are hashed into a second half of the table.

Training takes a bounded sample of labelled documents (MAX_FIT_DOCS ids, one text each). A sentence is scored by its most
toxic word, a document by its most toxic sentence, which is its most toxic word; so a document is a bag of the words of
its sentences. Which word of a toxic document carries the label is not given, so witnesses and the machine are found in
turn, from words whose letters are over-represented in toxic documents. Landmarks are witnesses and their most similar harmless words; Nystroem features K(x, L) K(L, L)^-1/2 make
the machine linear, trained by Newton steps on the squared hinge loss. As a landmark's kernel is a product of explicit
subsequence weights, the machine folds into one table of a weight for each subsequence: scoring a word costs
one look-up for each of its subsequences, whatever the number of landmarks.

Defined results: null and empty texts, and texts without letters, get the score of a document without any word; every
row gives a row, repeated rows and null ids too; further columns are not read. A labelled id counts once, with the
greatest label and the text of the least hash that it has. Without labelled rows of both classes the score is constant,
the share of toxic rows (0 without rows). Ties in training are broken by the words themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, release, worker_cache

ORDER, MAX_GAP, DECAY = 4, 2, 0.5
#: At most so many labelled documents are learned from, those with the least hash of their id.
MAX_FIT_DOCS = 4_000
LANDMARKS, ROUNDS = 160, 4
#: A word in such a share of toxic documents and in no other is a witness there even beside a clearer one.
TELLING = 0.05
#: Margins further out count as these: the machine aims at -1 and 1.
LOW, HIGH = -1.5, 1.0
#: Words whose scores one Python worker keeps; emptied when full.
CACHE_WORDS = 150_000
#: Longer words count as overlapping parts of so many characters.
MAX_WORD, OVERLAP = 40, 12
#: Neighbouring words of so many characters at most that are not among the COMMON harmless ones are read as one word too.
FRAGMENT, COMMON = 5, 20_000

_BITS = 5
_STEPS = [(a, b, c) for a in range(1, MAX_GAP + 2) for b in range(1, MAX_GAP + 2) for c in range(1, MAX_GAP + 2) if a + b + c <= ORDER - 1 + MAX_GAP]
# Digits and signs that stand for letters.
_FOLD = str.maketrans("013457@", "oieasta")
_spelled = re.compile(r"(?<!\S)(?:[^\W\d_][\s.*_-]){2,}[^\W\d_](?!\S)")


def _code(ch: str) -> int:
    """A letter's code: 1-26 for a-z with or without accents, from 32 on for other letters, 0 for what is no letter."""
    if not ch.isalpha():
        return 0
    base = unicodedata.normalize("NFKD", ch)[0].lower()
    return ord(base) - 96 if "a" <= base <= "z" else 32 + ord(ch)


class _Codes(dict):
    def __missing__(self, ch: str) -> int:
        self[ch] = c = _code(ch)
        return c


_codes = _Codes()
_EDGE = 31  # the ends of a word
#: Places of the table: one for each subsequence of a-z and edges, as many again for hashes of all others.
_SHIFT = 4 * _BITS + 1
TABLE, _PRIME, _MASK = 1 << _SHIFT, 1_000_003, (1 << 40) - 1


def segments(text: str | None, common: frozenset[str] | None = None) -> set[str]:
    """The distinct words of a text, lower-cased; words spelled out with gaps and, if common words are given, runs of other
    short words of a sentence are added as one."""
    t = (text or "").lower()
    ws = t.split()
    out = set(ws)
    if common is not None:
        short = [len(w) <= FRAGMENT and w not in common for w in ws]
        for i in [i for i, (x, y) in enumerate(zip(short, short[1:], strict=False)) if x and y]:
            if ws[i][-1] not in ".!?|":
                out.add(ws[i] + ws[i + 1])
                if i + 2 < len(ws) and short[i + 2] and ws[i + 1][-1] not in ".!?|":
                    out.add(ws[i] + ws[i + 1] + ws[i + 2])
    for m in _spelled.finditer(t):
        out.add("".join(ch for ch in m.group() if ch.isalpha()))
    if out and max(map(len, out)) > MAX_WORD:
        for w in [w for w in out if len(w) > MAX_WORD]:
            out.remove(w)
            out.update(w[i : i + MAX_WORD] for i in range(0, len(w) - OVERLAP, MAX_WORD - OVERLAP))
    return out


def _fold(word: str) -> list[int]:
    return [c for c in map(_codes.__getitem__, word.translate(_FOLD)) if c]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, value, norm): the kernel's explicit features of each word, equal codes of a word summed, and the
    length of its feature vector."""
    coded = [[_EDGE, *_fold(w), _EDGE] for w in words]
    length = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    flat = np.fromiter((c for w in coded for c in w), dtype=np.int64, count=int(length.sum()))
    owner = np.repeat(np.arange(len(coded)), length)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    plain = not len(flat) or flat.max() < 1 << _BITS
    keys, values = [], []
    for a, b, c in _STEPS:
        ok = np.flatnonzero(place + a + b + c < np.repeat(length, length))
        four = flat[ok], flat[ok + a], flat[ok + a + b], flat[ok + a + b + c]
        code = ((four[0] << _BITS | four[1]) << _BITS | four[2]) << _BITS | four[3]
        if not plain:
            mixed = (((four[0] * _PRIME + four[1]) * _PRIME + four[2]) * _PRIME + four[3]) & _MASK
            code = np.where(np.maximum(np.maximum(four[0], four[1]), np.maximum(four[2], four[3])) < 1 << _BITS, code, TABLE // 2 + (mixed * _PRIME >> 24) % (TABLE // 2))
        keys.append(owner[ok] << _SHIFT | code)
        values.append(np.full(len(ok), DECAY ** (a + b + c - ORDER + 1)))
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    value = np.add.reduceat(value, starts) if len(starts) else value
    key = key[starts]
    row, code = key >> _SHIFT, key & (TABLE - 1)
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(words)))
    return row, code, value, norm


@dataclass
class Model:
    """table: a weight for each subsequence; bias: the machine's; a, b, c: the document's score is
    1 / (1 + exp(-(a * margin + b * log(1 + toxic words) + c))). common: frequent harmless words, which are no fragments."""

    table: np.ndarray
    bias: float
    a: float
    b: float
    c: float
    common: frozenset[str] = frozenset()

    def margins(self, words: list[str]) -> np.ndarray:
        row, code, value, norm = features(words)
        return np.bincount(row, value * self.table[code], minlength=len(words)) / np.maximum(norm, 1e-9) + self.bias

    def score(self, margin: np.ndarray, n_toxic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b * np.log1p(n_toxic) + self.c, -50, 50)))


def _kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """K(words, marks)."""
    row, code, value, norm = features(marks)
    dense = {}
    for r, c, v in zip(row.tolist(), code.tolist(), value.tolist(), strict=True):
        dense.setdefault(c, []).append((r, v / max(norm[r], 1e-9)))
    known = np.array(sorted(dense), dtype=np.int64)
    matrix = np.zeros((len(known), len(marks)))
    for i, c in enumerate(known.tolist()):
        for r, v in dense[c]:
            matrix[i, r] += v
    out = np.zeros((len(words), len(marks)))
    for lo in range(0, len(words), 250):  # bounds the products held at once
        row, code, value, norm = features(words[lo : lo + 250])
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = np.flatnonzero(known[at] == code)
        if len(hit):
            starts = np.flatnonzero(np.concatenate([[True], np.diff(row[hit]) > 0]))  # rows come in order
            out[lo + row[hit][starts]] = np.add.reduceat(matrix[at[hit]] * value[hit, None], starts, axis=0)
        out[lo : lo + 250] /= np.maximum(norm, 1e-9)[:, None]
    return out


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-2, steps: int = 30) -> np.ndarray:
    """The squared-hinge machine with an intercept (the last weight), by Newton steps over its support vectors."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, eye = np.zeros(x1.shape[1]), np.eye(x1.shape[1]) * reg
    eye[-1, -1] = 1e-6
    before = None
    for _ in range(steps):
        on = y * (x1 @ w) < 1
        if before is not None and (on == before).all():
            break
        before = on
        xs = x1[on] * weight[on, None]
        w = np.linalg.solve(eye + xs.T @ x1[on], xs.T @ y[on])
    return w


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def _variants(word: str, rng: np.random.Generator, n: int = 6) -> list[str]:
    letters = "".join(ch for ch in word if ch.isalpha())
    out = []
    for _ in range(n if len(letters) > 3 else 0):
        at = int(rng.integers(1, len(letters)))
        out.append(letters[:at] + (letters[at] if rng.random() < 0.5 else chr(97 + int(rng.integers(26)))) + letters[at:])
    return out


_EMPTY = np.zeros(TABLE)
#: Harmless words of the sample that training keeps the features of, besides all words of toxic documents.
KEPT_HARMLESS, CHUNK = 40_000, 5_000


def _margins(model: Model, words: list[str]) -> np.ndarray:
    """Margins of many words, in chunks that bound the memory."""
    return np.concatenate([model.margins(words[k : k + CHUNK]) for k in range(0, len(words), CHUNK)] or [np.empty(0)])


def _by_code(words: list[str], counts: np.ndarray) -> np.ndarray:
    """How many documents hold each subsequence, a document counted for each of its words."""
    total = np.zeros(TABLE)
    for k in range(0, len(words), CHUNK):
        row, code, _, _ = features(words[k : k + CHUNK])
        total += np.bincount(code, counts[k : k + CHUNK][row], minlength=TABLE)
    return total


def _mean_odds(words: list[str], odds: np.ndarray) -> np.ndarray:
    out = []
    for k in range(0, len(words), CHUNK):
        row, code, value, norm = features(words[k : k + CHUNK])
        out.append(np.bincount(row, value * value * odds[code], minlength=len(norm)) / np.maximum(norm * norm, 1e-9))
    return np.concatenate(out or [np.empty(0)])


def train(bags: Iterable[tuple[Iterable[str], int]], seed: int = 7) -> Model:
    """bags: the distinct words of each labelled document and its label. Words are numbered at once, so that no more of the
    sample is held than each distinct word and an array of numbers for each document."""
    number: dict[str, int] = {}
    labels, numbered = [], []
    for ws, label in bags:
        labels.append(label)
        numbered.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), dtype=np.int32))
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(_EMPTY, 0.0, 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    # words in order, whatever the order of the documents' words
    names = sorted(number)
    place = np.empty(len(names), dtype=np.int32)
    place[[number[w] for w in names]] = np.arange(len(names))
    numbered = [np.sort(place[x]) for x in numbered]
    del number, place
    rng = np.random.default_rng(seed)
    count = lambda b: np.bincount(np.concatenate([np.empty(0, dtype=np.int32), *[x for x, k in zip(numbered, labels, strict=True) if k == b]]), minlength=len(names)).astype(float)
    bad_count, good_count = count(1), count(0)
    n_bad, n_good = y.sum(), len(y) - y.sum()
    # how much more often documents that hold a subsequence are toxic
    of = lambda c: _by_code([names[i] for i in np.flatnonzero(c)], c[c > 0])
    in_bad = of(bad_count)
    odds = np.log((in_bad + 0.5) / (n_bad + 1)) - np.log((of(good_count) + 0.5) / (n_good + 1))
    odds *= np.minimum(1, in_bad / 8)
    del in_bad
    # the words that training looks at: those of toxic documents, and harmless ones, the frequent first
    harmless = np.flatnonzero(bad_count == 0)
    harmless = harmless[np.argsort(-good_count[harmless], kind="stable")]
    often, others = harmless[: KEPT_HARMLESS // 4], harmless[KEPT_HARMLESS // 4 :]
    others = rng.choice(others, size=min(len(others), KEPT_HARMLESS - len(often)), replace=False)
    looked = np.sort(np.concatenate([np.flatnonzero(bad_count > 0), often, others]))
    vocabulary = [names[i] for i in looked.tolist()]
    seen_good, seen_bad = good_count[looked], bad_count[looked]
    first = _mean_odds(vocabulary, odds)
    del odds
    margin = np.where(seen_good > np.maximum(1, 0.02 * seen_bad), -np.inf, first)
    good_words = np.flatnonzero(seen_good > 0)
    bad_bags = [np.searchsorted(looked, x) for x, b in zip(numbered, labels, strict=True) if b and len(x)]
    known = set(names)
    least = max(8.0, TELLING * n_bad)
    telling = np.flatnonzero((seen_bad >= least) & (seen_good == 0)).tolist()
    model = Model(_EMPTY, 0.0, 0.0, 0.0, 0.0)
    for round_ in range(ROUNDS):
        # each toxic document's witness; the most frequent make landmarks
        seen = Counter(int(m[np.argmax(margin[m])]) for m in bad_bags)
        for i in telling:
            seen[i] = max(seen[i], int(seen_bad[i]))
        witness = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], vocabulary[x[0]])) if np.isfinite(margin[w])]
        if not witness:
            break
        hard = good_words[np.argsort(-margin[good_words], kind="stable")] if round_ else good_words[:0]
        some = rng.choice(good_words, size=min(len(good_words), LANDMARKS // 4), replace=False)
        marks = [vocabulary[i] for i in dict.fromkeys([*witness[: LANDMARKS // 2], *hard[: LANDMARKS // 4].tolist(), *some.tolist()])]
        spread = rng.choice(good_words, size=min(len(good_words), 8_000), replace=False)
        frequent = good_words[np.argsort(-seen_good[good_words], kind="stable")[:2_000]]
        against = np.unique(np.concatenate([spread, frequent, hard[:4_000]]))
        picked = [vocabulary[i] for i in [*witness, *against.tolist()]]
        target = np.concatenate([np.ones(len(witness)), -np.ones(len(against))])
        counts = np.array([seen[w] for w in witness], dtype=float)
        weight = np.concatenate([counts / counts.sum(), np.full(len(against), 1 / max(1, len(against)))]) * len(target) / 2
        # recurring witnesses also with a letter inserted or doubled, unless that makes a word of the sample
        varied = [v for i in witness[:60] if seen[i] >= 3 for v in _variants(vocabulary[i], rng) if v not in known]
        if varied:
            target = np.concatenate([target, np.ones(len(varied))])
            weight = np.concatenate([weight, np.full(len(varied), 0.06 * len(picked) / len(varied))])
        values, vectors = np.linalg.eigh(_kernel(marks, marks) + 1e-6 * np.eye(len(marks)))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        w = _newton(_kernel(picked + varied, marks) @ root, target, weight)
        model = folded(marks, root @ w[:-1], float(w[-1]))
        margin = _margins(model, vocabulary)
    final = _margins(model, names)
    top = np.array([final[x].max() if len(x) else LOW for x in numbered])
    hits = np.array([(final[x] > 0).sum() for x in numbered], dtype=float)
    a, b, c = _logistic(np.column_stack([np.clip(top, LOW, HIGH), np.log1p(hits), np.ones(len(top))]), y)
    usual = harmless[good_count[harmless] > 1][:COMMON].tolist() + np.flatnonzero((bad_count > 0) & (good_count > 1)).tolist()
    return Model(model.table.astype(np.float32), model.bias, float(a), float(b), float(c), frozenset(names[i] for i in usual if final[i] <= 0))


def folded(marks: list[str], alpha: np.ndarray, bias: float) -> Model:
    """The machine K(x, marks) alpha + bias as one weight for each subsequence."""
    r, c, v, norm = features(marks)
    return Model(np.bincount(c, v / np.maximum(norm, 1e-9)[r] * alpha[r], minlength=TABLE), bias, 0.0, 0.0, 0.0)


def labelled_bags(docs: DataFrame, labels: DataFrame, limit: int = MAX_FIT_DOCS) -> Iterator[tuple[list[str], int]]:
    """Distinct words and label of at most `limit` labelled documents, drawn evenly by the hash of the id. The bound on
    ids makes their broadcast one; words are cut out on the executors, and rows that repeat an id are reduced to one."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "own": pdf["own"], "words": [" ".join(sorted(segments(t))) for t in pdf["text"]]})

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("own"), "text")
    rows = rows.mapInPandas(run, "doc_id long, toxic int, own long, words string").groupBy("doc_id").agg(F.min(F.struct("own", "toxic", "words")).alias("x"))
    for r in sorted(rows.select("doc_id", "x.toxic", "x.words").collect()):
        yield r.words.split(" ") if r.words else [], r.toxic


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_FIT_DOCS) -> Model:
    model = train(labelled_bags(docs, labels, limit))
    release()
    return model


def _scorer(docs: DataFrame, model: Model):
    """texts -> (margin, toxic words, score), for use in tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = hash((model.table.tobytes(), model.bias, len(model.common)))

    def of(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = shared.value
        cache = worker_cache(token)
        top, hits = np.full(len(texts), LOW), np.zeros(len(texts))
        for lo in range(0, len(texts), 500):
            bags = [segments(t, m.common) for t in texts.iloc[lo : lo + 500]]
            if len(cache) > CACHE_WORDS:
                cache.clear()
            new = [w for w in set().union(*bags) if w not in cache]
            for k in range(0, len(new), CHUNK):
                part = new[k : k + CHUNK]
                cache.update(zip(part, m.margins(part).tolist(), strict=True))
            for i, bag in enumerate(bags, lo):
                if bag:
                    got = [cache[w] for w in bag]
                    top[i], hits[i] = max(got), sum(g > 0 for g in got)
        top = np.clip(top, LOW, HIGH)
        return top, hits, m.score(top, hits)

    return of


def keep(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of docs that score below the limit, all columns as they are."""
    of = _scorer(docs, model)

    @F.pandas_udf("double")
    def total(texts: pd.Series) -> pd.Series:
        return pd.Series(of(texts)[2])

    return docs.where(total("text") < below)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, margin (of the most toxic word), n_toxic (distinct words over the margin), score (0 to 1)."""
    of = _scorer(docs, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches):
            top, hits, total = of(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "margin": top, "n_toxic": hits.astype(np.int64), "score": total})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, margin double, n_toxic long, score double")
