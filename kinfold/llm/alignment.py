"""Alignment of two tokenizers over a corpus: which tokens of A and B cover the same bytes, and how many documents hold each pair.

Each text is encoded by both; the byte offsets where tokens of both end cut them into groups, and tokens whose byte ranges overlap
are linked. Units of text at whose ends both tokenizers always cut (a space or line break behind anything but white
space) are encoded once and kept by each Python worker; longer or rarer ones just cost their encoding.

Counts live in dense matrices striped by the id of A: id a has row a // stripes of stripe a % stripes, so that frequent
ids, which are neighbours, part. Tasks count the pairs of their own documents, the stripes add those up (np.add.at) and give row maxima.
The links of all documents go to the stripes as packed arrays, a stripe as many times as its links need (its counts are
bounded by the vocabularies), are scored beside the counts and summed for each block of documents.

Defined results: texts that are null, empty or do not come back from both tokenizers have no tokens: zeros and an empty
groups_sha256; repeated rows are documents of their own, each counted; of equal counts all are best; an empty table gives no row;
further columns are not carried. No task holds more than a block of documents, one text, or one stripe.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, worker_cache

#: Ids of A in a stripe; a stripe's counts are a dense matrix of so many rows and a column for each id of B.
STRIPE_ROWS = 512
#: Characters and documents of a block: what is encoded and packed at once. A longer text is a block of its own.
BLOCK_CHARS, BLOCK_DOCS = 500_000, 5_000
#: Links of a packed row, links that one task scores of a stripe, and pairs that a task counts before it hands them on.
ROW_LINKS, TASK_LINKS, HELD_PAIRS = 50_000, 50_000_000, 4_000_000
#: Units, and characters of them, that a Python worker keeps.
CACHE_UNITS, CACHE_CHARS = 300_000, 16_000_000
#: White space, anything else, and on up to a space or line break behind it; at the end white space alone.
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_TABLE = "kind string, block long, seq int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, n int, docs binary, runs binary, a binary, b binary, m binary"
_COLUMNS = [c.split()[0] for c in _TABLE.split(", ")]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers and the bytes of their tokens. A: a byte-level vocabulary in JSON, B: a piece model."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte, special = byte_level(), {t["id"]: t["content"] for t in spec["added_tokens"]}
        named = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.bytes_a = [special[i].encode() if i in special else bytes(byte[c] for c in t) for i, t in enumerate(named)]
        ids = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, ids))]
        self.len_a, self.len_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.names = np.array([f"{i}{sep}" for sep in ",|;" for i in range(max(len(self.bytes_a), len(self.bytes_b)))], dtype=object)
        self.stripes = -(-len(self.bytes_a) // STRIPE_ROWS)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as f:
            proto.ParseFromString(f.read())
        pre = spec["pre_tokenizer"] or {}
        inner = [p for i, p in zip(ids, map(self.b.id_to_piece, ids)) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: Whether both cut wherever a unit ends. Otherwise a text is one unit.
        self.cuts = (
            spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and proto.normalizer_spec.name == "identity" and not proto.normalizer_spec.remove_extra_whitespaces
            and not any("\n" in p or re.search("[^▁]▁", p) for p in inner) and len(self.b.encode("\n")) == 2
        )
        self.keep(worker_cache((path_a, path_b)))

    def keep(self, cache: dict) -> None:
        """Units and their numbers, in a dictionary that the worker owns; what they hold stands in arrays by number."""
        self.number = cache
        self._forget()

    def _forget(self) -> None:
        self.number.clear()
        self.chars, self.groups = 0, []
        self.fine, self.sizes = np.zeros(0, bool), np.zeros((0, 4), np.int64)
        self.start, self.link = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each unit, which bears the space before its text."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        if self.cuts:  # behind a line break of its own, where B's own space stays apart
            return a, [x[2:] for x in self.b.encode(["\n" + u for u in units], num_threads=1)]
        return a, self.b.encode([u[1:] for u in units], num_threads=1)

    def learn(self, units: list[str]) -> None:
        """Numbers for new units: whether they come back, their counts of tokens, groups and links, the links, the groups."""
        a, b = self.encode(units)
        raw = [u.encode("utf-8", "replace") for u in units]
        whole = b"".join(raw)
        fine = np.ones(len(units), bool)
        if not (whole == b"".join([self.bytes_a[i] for x in a for i in x]) == b"".join([self.bytes_b[i] for x in b for i in x])):
            fine = np.array([u == b"".join([self.bytes_a[i] for i in x]) == b"".join([self.bytes_b[i] for i in y]) for u, x, y in zip(raw, a, b)])
            a, b, raw = ([x if ok else x[:0] for x, ok in zip(part, fine)] for part in (a, b, raw))
        ends = np.cumsum([len(u) for u in raw])
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        ids_a, ids_b = np.array([i for x in a for i in x], np.int64), np.array([i for x in b for i in x], np.int64)
        end_a, end_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        both, either = np.intersect1d(end_a, end_b, assume_unique=True), np.union1d(end_a, end_b)
        # no token ends within the overlap of two, so that each end of either is the end of just one overlap
        link = ids_a[np.searchsorted(end_a, either)] << 16 | ids_b[np.searchsorted(end_b, either)]
        n_links = np.diff(np.searchsorted(either, ends, "right"), prepend=0)
        n_groups = np.diff(np.searchsorted(both, ends, "right"), prepend=0)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = (np.isin(e, both, assume_unique=True) for e in (end_a, end_b))
        written, half = np.empty(len(ids_a) + len(ids_b), dtype=object), len(self.names) // 3
        written[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = self.names[ids_a + half * last_a]
        written[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = self.names[ids_b + 2 * half * last_b]
        words, stop = written.tolist(), np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(words[lo:hi])[:-1] for lo, hi in zip([0, *stop[:-1]], stop)]
        self.number.update(zip(units, range(len(self.fine), len(self.fine) + len(units))))
        self.chars += sum(map(len, units))
        self.fine, self.sizes = np.concatenate([self.fine, fine]), np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self.start, self.link = np.concatenate([self.start, self.start[-1] + np.cumsum(n_links)]), np.concatenate([self.link, link.astype(np.uint32)])

    def block(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray]:
        """For each text n_a, n_b, n_groups, n_links and groups_sha256, and all links as text << 32 | a << 16 | b."""
        units = [[] if not t else UNIT.findall(" " + t) if self.cuts else [" " + t] for t in texts]
        if len(self.number) > CACHE_UNITS or self.chars > CACHE_CHARS:
            self._forget()
        if new := [u for u in dict.fromkeys(u for x in units for u in x) if u not in self.number]:
            self.learn(new)
        rows, links = [], []
        for i, x in enumerate(units):
            at = list(map(self.number.__getitem__, x))
            if not at or not self.fine[at].all():
                rows.append((0, 0, 0, 0, ""))
                continue
            sizes = self.sizes[at]
            rows.append((*sizes.sum(axis=0).tolist(), hashlib.sha256(";".join(map(self.groups.__getitem__, at)).encode()).hexdigest()))
            n, to = sizes[:, 3], np.cumsum(sizes[:, 3])
            links.append(self.link[np.repeat(self.start[at] - to + n, n) + np.arange(to[-1])] | np.int64(i) << 32)
        return rows, np.concatenate(links) if links else np.zeros(0, np.int64)


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizers(path_a: str, path_b: str) -> Pair:
    """One pair for each Python worker, with its units, across batches and tasks."""
    key = (path_a, path_b)
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    elif _pairs[key].number is not (cache := worker_cache(key)):  # another operator's turn came between
        _pairs[key].keep(cache)
    return _pairs[key]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    """The ids and texts of each block."""
    ids, texts, chars = [], [], 0
    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
            size = len(text) if isinstance(text, str) else 0
            if texts and (chars + size > BLOCK_CHARS or len(texts) == BLOCK_DOCS):
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            texts.append(text if isinstance(text, str) else None)
            chars += size
    if texts:
        yield ids, texts


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS, dtype=object)


def _by_stripe(stripe: np.ndarray, stripes: int) -> Iterator[tuple[int, slice]]:
    """The slices of a sorted array of stripes."""
    at = np.searchsorted(stripe, np.arange(stripes + 1)).tolist()
    for s, (lo, hi) in enumerate(zip(at, at[1:])):
        if lo < hi:
            yield s, slice(lo, hi)


def _link_rows(block: int, links: np.ndarray, pair: Pair) -> tuple[list[dict], np.ndarray]:
    """Packed rows of a block's links, each at most ROW_LINKS of one stripe, and its pairs, one for each text and pair."""
    a = links >> 16 & 0xFFFF
    keys, m = np.unique((a % pair.stripes) << 48 | links, return_counts=True)
    rows = []
    for s, part in _by_stripe(keys >> 48, pair.stripes):
        for lo in range(part.start, part.stop, ROW_LINKS):
            k = keys[lo : min(part.stop, lo + ROW_LINKS)]
            docs, runs = np.unique(k >> 32 & 0xFFFF, return_counts=True)
            row, col = (k >> 16 & 0xFFFF) // pair.stripes, k & 0xFFFF
            packed = {"docs": docs.astype(np.uint16), "runs": runs.astype(np.uint32), "a": row.astype(np.uint16), "b": col.astype(np.uint16), "m": m[lo : lo + len(k)].astype(np.uint32)}
            rows.append({"kind": "link", "block": block, "stripe": s, "n": len(k)} | {c: x.tobytes() for c, x in packed.items()})
    return rows, keys & 0xFFFFFFFF


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate([n for _, n in parts]))
    return keys, n


def _count_rows(parts: list[tuple[np.ndarray, np.ndarray]], pair: Pair) -> list[dict]:
    """A packed row of pair counts for each stripe."""
    keys, n = _summed(parts)
    a = keys >> 16
    order = np.argsort(a % pair.stripes, kind="stable")
    keys, a, n = keys[order], a[order], n[order]
    return [
        {"kind": "count", "stripe": s, "n": at.stop - at.start, "a": (a[at] // pair.stripes).astype(np.uint16).tobytes(), "b": (keys[at] & 0xFFFF).astype(np.uint16).tobytes(), "m": n[at].tobytes()}
        for s, at in _by_stripe(a % pair.stripes, pair.stripes)
    ]


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One pass over the texts, written once: rows of kind doc (a document), link (packed links of a block in a stripe) and count
    (a task's packed pair counts in a stripe)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, first = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for i, (ids, texts) in enumerate(_blocks(batches)):
            got, links = pair.block(texts)
            names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            rows, pairs = _link_rows(first + i, links, pair)
            yield _frame([{"kind": "doc", "block": first + i, "seq": j, "doc_id": d} | dict(zip(names, g)) for j, (d, g) in enumerate(zip(ids, got))] + rows)
            held.append(np.unique(pairs, return_counts=True))
            if sum(len(k) for k, _ in held) > HELD_PAIRS:
                held = [_summed(held)]
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield _frame(_count_rows(held, pair))
                    held = []
        if held:
            yield _frame(_count_rows(held, pair))

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, _TABLE), by="kind")


def stripe_counts(table: DataFrame, columns: int) -> DataFrame:
    """The whole counts of each stripe: stripe, n, a, b, m (packed; m: documents of each pair). columns: ids of B."""

    def whole(stripe: int, count: np.ndarray) -> pd.DataFrame:
        a, b = np.nonzero(count)
        return pd.DataFrame([{"stripe": stripe, "n": len(a), "a": a.astype(np.uint16).tobytes(), "b": b.astype(np.uint16).tobytes(), "m": count[a, b].tobytes()}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stripe, count = None, np.zeros((STRIPE_ROWS, columns), np.int64)
        for pdf in batches:
            for s, a, b, m in pdf[["stripe", "a", "b", "m"]].itertuples(index=False):
                if s != stripe:
                    if stripe is not None:
                        yield whole(stripe, count)
                        count[:] = 0
                    stripe = s
                np.add.at(count, (np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)), np.frombuffer(m, np.int64))
        if stripe is not None:
            yield whole(stripe, count)

    rows = table.where("kind = 'count'").select("stripe", "a", "b", "m")
    return rows.repartition("stripe").sortWithinPartitions("stripe").mapInPandas(run, "stripe int, n int, a binary, b binary, m binary")


def scored_links(table: DataFrame, counts: DataFrame, stripes: int, columns: int) -> DataFrame:
    """block, docs, best, sums: for a packed row of links its documents, their links that are best of A's id, and their counts."""
    links = table.where("kind = 'link'")
    size = {r.stripe: r.n for r in links.groupBy("stripe").agg(F.sum("n").alias("n")).collect()}  # at most a row for each stripe
    shares = F.lit([-(-size.get(s, 0) // TASK_LINKS) or 1 for s in range(stripes)])
    share = F.element_at(shares, F.col("stripe") + 1)
    none = F.lit(None).cast("binary")
    left = counts.select("stripe", F.explode(F.sequence(F.lit(0), share - 1)).alias("share"), F.lit(0).alias("order"), F.lit(None).cast("long").alias("block"), none.alias("docs"), none.alias("runs"), "a", "b", "m")
    right = links.select("stripe", F.pmod(F.xxhash64("block"), share).cast("int").alias("share"), F.lit(1).alias("order"), "block", "docs", "runs", "a", "b", "m")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros((STRIPE_ROWS, columns), np.int64)
        for pdf in batches:
            out = []
            for x in pdf.itertuples(index=False):
                a, b = np.frombuffer(x.a, np.uint16), np.frombuffer(x.b, np.uint16)
                if x.order == 0:  # the counts come before the links that they score
                    count[:] = 0
                    count[a, b] = np.frombuffer(x.m, np.int64)
                    most = count.max(axis=1)
                    continue
                n, m, runs = count[a, b], np.frombuffer(x.m, np.uint32).astype(np.int64), np.frombuffer(x.runs, np.uint32).astype(np.int64)
                at = np.cumsum(runs) - runs
                best, sums = np.add.reduceat(m * (n == most[a]), at), np.add.reduceat(m * n, at)
                out.append({"block": x.block, "docs": x.docs, "best": best.astype(np.uint32).tobytes(), "sums": sums.tobytes()})
            yield pd.DataFrame(out, columns=["block", "docs", "best", "sums"])

    dealt = left.unionByName(right).repartition("stripe", "share").sortWithinPartitions("stripe", "share", "order")
    return dealt.mapInPandas(run, "block long, docs binary, best binary, sums binary")


def align(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their counts (see RESULT), and stripe_counts(). The vocabulary files must be at the same path on every machine."""
    pair = tokenizers(path_a, path_b)
    stripes, columns = pair.stripes, len(pair.bytes_b)
    if columns > 1 << 16 or len(pair.bytes_a) > 1 << 16:
        raise ValueError("ids are packed in 16 bits")
    table = encoded(docs, path_a, path_b)
    counts = stripe_counts(table, columns)
    scores = scored_links(table, counts, stripes, columns)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        totals = np.zeros((2, int(left["seq"].max()) + 1 if len(left) else 0), np.int64)
        for docs_, best, sums in right[["docs", "best", "sums"]].itertuples(index=False):
            at = np.frombuffer(docs_, np.uint16)
            totals[0, at] += np.frombuffer(best, np.uint32)
            totals[1, at] += np.frombuffer(sums, np.int64)
        seq = left["seq"].to_numpy(np.int64)
        return left.assign(n_best=totals[0, seq], count_sum=totals[1, seq])[names]

    rows = table.where("kind = 'doc'").select("block", "seq", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return rows.groupBy("block").cogroup(scores.groupBy("block")).applyInPandas(summed, RESULT), counts


def pair_counts(counts: DataFrame, stripes: int) -> DataFrame:
    """a, b, n (documents that hold the pair linked), best (whether no pair of a has more), out of stripe_counts()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, a, b, m in pdf[["stripe", "a", "b", "m"]].itertuples(index=False):
                row, n = np.frombuffer(a, np.uint16), np.frombuffer(m, np.int64)
                most = np.zeros(STRIPE_ROWS, np.int64)
                np.maximum.at(most, row, n)
                yield pd.DataFrame({"a": row.astype(np.int32) * stripes + s, "b": np.frombuffer(b, np.uint16).astype(np.int32), "n": n, "best": n == most[row]})

    return counts.select("stripe", "a", "b", "m").mapInPandas(run, "a int, b int, n long, best boolean")
