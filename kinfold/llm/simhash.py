"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set where over half of the 64-bit hashes of the text's word shingles have it. Every bit
position gets a vector of radius + 1 bits; table v (any such vector but zero) keeps the positions whose vector has
an odd product with v. The vectors of radius differing positions leave some v orthogonal to all of them, so a pair
within the radius agrees on all that table v keeps: no pair is missed, for any fingerprints.

Equal fingerprints are one node. A bucket is the set of distinct fingerprints that agree in one table. A bucket over
`hot` fingerprints is covered again by tables over the bits it leaves free, after which at most
2^(bits still free) fingerprints, 2^17 for 64 bits and radius 3, can agree, whatever the data. Within a bucket only
the links of a spanning forest leave the task, never its pairs, and components do not change by that.

Defined results: null text is empty; an empty text has fingerprint zero and is linked like any other; a text of fewer
words than a shingle has one shingle, its whole sequence; rows are kept as they are, repeated rows and null ids too
(component_id is the least id that is not null, null if there is none); further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_bytes, parts, small, worker_cache
from .components import connected_components

BITS, HOT = 64, 2048


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text."""
    ws = lower_bytes(text or "").split()
    if not ws:
        return 0
    n = max(1, len(ws) - shingle + 1)
    hash_, join = xxhash.xxh64_intdigest, b" ".join
    votes = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, 65_536):  # bounds what a very long text holds at once
        hi = min(n, lo + 65_536)
        h = np.fromiter((hash_(join(ws[i : i + shingle]), seed) for i in range(lo, hi)), dtype=np.uint64, count=hi - lo)
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.dot((2 * votes > n).astype(np.uint64), np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("simhash")  # drops those of other operators
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """For each table the mask of the positions it keeps. Positions get the non-zero vectors in turn, so that the
    tables keep as near as possible the same number of bits."""
    width = (1 << (radius + 1)) - 1
    vector = {p: 1 + k % width for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, width + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _keys(masks: list[int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k")) for t, m in enumerate(masks)]))


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints within the radius: a search from each one not yet reached."""
    x = fps.view(np.uint64)
    if len(x) == 2:  # most buckets
        near = bool(np.bitwise_count(x[0] ^ x[1]) <= radius)
        return fps[:near], fps[1 : 1 + near]
    us, vs, rest = [fps[:0]], [fps[:0]], np.arange(len(x))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(x[rest] ^ x[at]) <= radius
            if near.any():
                new, rest = rest[near], rest[~near]
                todo.extend(new)
                us.append(np.full(len(new), fps[at]))
                vs.append(fps[new])
    return np.concatenate(us), np.concatenate(vs)


def links(fps: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """(u, v) links between distinct fingerprints, enough to connect all that are within the radius."""
    masks = covering_masks(list(range(BITS)), radius)
    keyed = fps.select("fp", _keys(masks).alias("x")).select("fp", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["t", "k"]))
    cold = shared.where(F.col("n") <= hot).groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps")
    again = F.lit(None)
    for t, m in enumerate(masks):
        free = [p for p in range(BITS) if not m >> p & 1]
        inner = covering_masks(free, radius)
        again = F.when(F.col("t") == t, F.array(*[F.struct(F.lit(s).cast("short").alias("t2"), F.col("fp").bitwiseAND(F.lit(_signed(i)).cast("long")).alias("k2")) for s, i in enumerate(inner)])).otherwise(again)
    warm = shared.where(F.col("n") > hot).select("fp", "t", "k", F.explode(again).alias("x")).select("fp", "t", "k", "x.t2", "x.k2")
    warm = warm.groupBy("t", "k", "t2", "k2").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_forest(np.asarray(x, dtype=np.int64), radius) for x in pdf["fps"]]
            yield pd.DataFrame({"u": np.concatenate([g[0] for g in got]), "v": np.concatenate([g[1] for g in got])})

    return cold.unionByName(warm).mapInPandas(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    prints = cut(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(nodes.select("fp"), radius, hot))
    least = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(least, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: the wider relation that a pipeline wants ---------------------------------------------------

#: Words of a shingle. Texts are near copies if they share four fifths of their shingles, which the arithmetic below is that of.
SHINGLE = 5
#: Rows that may be broadcast, of 16 bytes.
MAX_PAIRED_TEXTS, MAX_BUCKETS = 500_000, 1_000_000
#: Slots into which the shingles of all texts are counted for their order.
SLOTS = 1 << 20
#: Longs of the parities that travel with a text into its buckets; of its wide ones there are as many as it has shingles / 64.
LONGS = 8


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of a shorter text that of its whole sequence."""
    ws = lower_bytes(text or "").split()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(ws[i : i + n])) for i in range(max(1, len(ws) - n + 1))), dtype=np.uint64)).view(np.int64)


def prefix(sh: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in the order of (rank of the slot, hash). Texts of n and m shingles, n // 5 of which at most are
    not shared, have one in common among their first n // 5 + 1 and m // 5 + 1, and two (if n, m > 1) among one more."""
    return sh[np.lexsort((sh, common[sh & (SLOTS - 1)]))][: len(sh) // 5 + 2]


def parities(sh: np.ndarray) -> np.ndarray:
    """For each of a power of two of slots, no fewer than there are shingles, whether an odd number of them fall in it. Two texts
    differ in at most as many slots as there are shingles in only one of them. The two halves, one over the other, are the
    parities of half the slots."""
    longs = max(LONGS, 1 << (max(1, -(-len(sh) // 64)) - 1).bit_length())
    odd = np.bincount((sh >> 20) & (64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def narrow(wide: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(wide.reshape(-1, LONGS), axis=0)


def sifted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (u, v), whose lengths are alike, that their wide parities allow."""
    side = lambda c, n, x: nodes.select(F.col("own").alias(c), F.col("n").alias(n), F.col("wide").alias(x))
    xor = lambda a, b: a.bitwiseXOR(b)
    longs = F.least(F.size("x"), F.size("y"))
    folded = lambda c: F.when(F.size(c) == longs, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, longs), F.slice(c, longs + 1, longs), xor))
    apart = F.aggregate(F.zip_with(folded("x"), folded("y"), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda n, k: n + k)
    met = pairs.join(side("u", "nx", "x"), "u").join(side("v", "ny", "y"), "v")
    return cut(met.where(9 * apart <= F.col("nx") + F.col("ny")).select("u", "v"))


def common_slots(texts: DataFrame) -> np.ndarray:
    """For each slot the rank of its count among the counts of all slots. Every text's distinct shingles count, so that common
    ones come last and buckets stay small. Any ranks give the same pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("simhash")  # drops those of other operators
        n = np.zeros(SLOTS, dtype=np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                np.add.at(n, shingle_hashes(t) & (SLOTS - 1), 1)  # two shingles of a text may share a slot
        at = np.flatnonzero(n)
        yield pd.DataFrame({"slot": at.astype(np.int32), "n": n[at]})

    got = texts.select("text").mapInPandas(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return np.unique(counts, return_inverse=True)[1].astype(np.int32)


def crossing(own: np.ndarray, root: np.ndarray, n: np.ndarray, i: np.ndarray, par: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket's texts under different roots that may be similar: of its shingles a text has n, i of which precede the
    bucket's. Of similar texts at most a ninth of both's shingles is in only one of them, and the lengths are alike."""
    order = np.argsort(n, kind="stable")
    own, root, n, i, par = own[order], root[order], n[order], i[order], par[order]
    ends = np.searchsorted(n, n * 5 // 4, side="right")
    for at in range(len(own) - 1):
        far = np.arange(at + 1, ends[at])
        far = far[(root[far] != root[at]) & (9 * (i[far] + i[at]) <= n[far] + n[at])]
        far = far[9 * np.bitwise_count((par[far] ^ par[at]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= n[far] + n[at]]
        if len(far):
            yield np.minimum(own[far], own[at]), np.maximum(own[far], own[at])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that share four fifths of their shingles. pairs: a table that is cheap to read again."""
    wanted = small(cut(pairs.select(F.explode(F.array("u", "v")).alias("own")).distinct()), MAX_PAIRED_TEXTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches):
            yield pd.DataFrame({"own": pdf["own"].array, "sh": pd.Series([shingle_hashes(t) for t in pdf["text"]], dtype=object)})

    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"), "text").join(wanted, "own")
    sets = cut(texts.mapInPandas(run, "own long, sh array<long>").dropDuplicates(["own"]))

    both = pairs.join(sets.select(F.col("own").alias("u"), F.col("sh").alias("a")), "u").join(sets.select(F.col("own").alias("v"), F.col("sh").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))  # four fifths of all, in whole numbers
    return both.where(5 * shared >= 4 * (F.size("a") + F.size("b") - shared)).select("u", "v")


def similar_links(nodes: DataFrame, edges: DataFrame, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, root) of edges and of all pairs of texts that share four fifths of their shingles. nodes: own, n, wide, par, pre.

    Similar texts share a shingle of their prefixes, so that they meet in its bucket: no pair is missed. First each text
    meets its bucket's leader, the least of a hash, which is nearly always the same one in all buckets of a group of copies.
    What edges and leaders connect needs no further pair. Of the buckets that hold more than one component then all pairs
    across components are compared in a task; a bucket over `hot` texts is split by a second shared shingle before. Only
    pairs that lengths, places and parities allow leave a task, and every pair is verified by its shingles."""
    roots = cut(connected_components(edges))
    keyed = nodes.select("own", F.col("n").alias("len"), F.posexplode("pre").alias("i", "k")).where(F.col("i") <= F.floor(F.col("len") / 5))
    sizes = cut(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(keyed.join(small(sizes, MAX_BUCKETS), "k"))
    lead = F.min(F.struct(F.xxhash64("own").alias("h"), "own", "len"))
    leaders = shared.groupBy("k").agg(lead.alias("b")).select("k", F.col("b.own").alias("other"), F.col("b.len").alias("lb"))
    met = shared.select("k", "own", "len").join(leaders, "k").where("own <> other and 5 * least(len, lb) >= 4 * greatest(len, lb)").select(F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v")).distinct()
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    met = met.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")
    first = verified(sifted(met, nodes), docs)
    roots = cut(connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(first)))

    rooted = shared.select("k", "n", "own", "len", "i").join(roots.withColumnRenamed("node", "own"), "own", "left")
    rooted = cut(rooted.withColumn("root", F.coalesce("root", "own")))
    mixed = rooted.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("k")
    rooted = rooted.join(mixed, "k").join(nodes.select("own", "par", "pre"), "own")
    later = F.slice("pre", F.col("i") + 2, F.greatest(F.size("pre") - F.col("i") - 1, F.lit(0)))
    second = F.when((F.col("n") <= hot) | (F.size(later) == 0), F.array(F.lit(0).cast("long"))).otherwise(later)
    split = rooted.select("k", F.explode(second).alias("k2"), "own", "root", "len", "i", "par").groupBy("k", "k2").agg(F.collect_list(F.struct("own", "root", "len", "i", "par")).alias("a")).where(F.size("a") > 1)
    split = split.select(F.col("a.own").alias("own"), F.col("a.root").alias("root"), F.col("a.len").alias("len"), F.col("a.i").alias("i"), F.flatten("a.par").alias("par"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, root, n, i, par in zip(pdf["own"], pdf["root"], pdf["len"], pdf["i"], pdf["par"], strict=True):
                cols = [np.asarray(c, dtype=np.int64) for c in (own, root, n, i)]
                for u, v in crossing(*cols, np.asarray(par, dtype=np.int64).reshape(-1, LONGS)):
                    yield pd.DataFrame({"u": u, "v": v})

    rest = sifted(split.mapInPandas(run, "u long, v long").distinct(), nodes)
    if rest.isEmpty():
        return roots
    more = verified(rest, docs)
    return cut(connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)))


def near_copies(docs: DataFrame, radius: int = 3, shingle: int = 3, hot: int = HOT) -> DataFrame:
    """doc_id, own (hash of the text), component_id by either relation: fingerprints within the radius, as near_duplicates()
    has it, or four fifths of equal five-word shingles. head: whether the row's id and text stand for the component,
    which rows that repeat both share."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"), "text")
    common = common_slots(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("simhash")  # drops those of other operators
        for pdf in parts(batches):
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.uint64)
            sets = [shingle_hashes(t) for t in pdf["text"]]
            wide, pre = [parities(x) for x in sets], [prefix(x, common) for x in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "own": pdf["own"].array, "fp": fp.view(np.int64), "n": [len(x) for x in sets], "wide": pd.Series(wide, dtype=object), "par": pd.Series([narrow(x) for x in wide], dtype=object), "pre": pd.Series(pre, dtype=object)})

    prints = cut(texts.mapInPandas(run, "doc_id long, own long, fp long, n long, wide array<long>, par array<long>, pre array<long>"))
    nodes = cut(prints.drop("doc_id").dropDuplicates(["own"]))
    heads = cut(nodes.groupBy("fp").agg(F.min("own").alias("head")))
    by_bits = links(heads.select("fp"), radius, hot)
    by_bits = by_bits.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("hu")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("hv")), "v")
    edges = by_bits.select(F.col("hu").alias("u"), F.col("hv").alias("v"))
    edges = edges.unionByName(nodes.join(heads, "fp").where("own <> head").select(F.col("own").alias("u"), F.col("head").alias("v")))
    roots = similar_links(nodes.select("own", "n", "wide", "par", "pre"), edges, docs, hot).withColumnRenamed("node", "own")
    ids = prints.groupBy("own").agg(F.min("doc_id").alias("least"))
    ids = cut(ids.join(roots, "own", "left").select("own", "least", F.coalesce("root", "own").alias("root")))
    first = ids.groupBy("root").agg(F.min(F.when(F.col("least").isNotNull(), F.struct("least", "own"))).alias("first"))
    of = ids.join(first, "root").select("own", F.col("first.least").alias("component_id"), (F.col("first.own") == F.col("own")).alias("is_first"))
    rows = prints.select("doc_id", "own").join(of, "own")
    return rows.select("doc_id", "own", "component_id", F.coalesce(F.col("is_first") & (F.col("doc_id") == F.col("component_id")), F.lit(False)).alias("head"))
