"""Line dedup by a deletion-neighbourhood join.

A line is the words between two newlines, in lower-case A-Z, joined by one space. A line goes if an earlier one, by
(doc_id, line number), is the same or, where both have MIN_WORDS words or more, within one edit of words: one word
inserted, deleted or replaced. The rest of the document stays as it is, in order.

Same lines are found by their 128-bit hash. For the others every distinct line emits the hash of itself and of each
variant with one word left out. Two lines one replacement apart share the variant without that word, two lines one
insertion apart share the shorter one itself; so the keys' minima give the earliest partner and no pairs are listed.
Only lines that share their first or last third or more with another line emit variants: one edit leaves one of the
two untouched, so that this loses nothing and spares nearly all lines the emission. Partners are verified word by word.
Keys are 64-bit hashes; one that meets another line's by chance could hide a partner, at a rate of the number of
variants over 2^64 for each.

Defined results: null text has no lines and stays null; blank lines are never dropped; rows that repeat a
(doc_id, text) are one document and treated alike; null ids come first; a text of which every line goes is empty;
equal lines of one document: the first stays. Further columns are kept; one called n_dropped is replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, let, lower_bytes, small, worker_cache

#: Of lines with fewer words only equal ones are found: one edit makes another line of them.
MIN_WORDS = 5
#: Rows that may be broadcast, of 16 to 120 bytes each.
MAX_KEYS = 300_000
#: Lengths of compared ends: each the greatest that is at most half the line, so that it is a third of it or more.
ENDS = sorted({int(2 * 1.5**k) for k in range(60)})
_BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = ("doc_id", "no", "own")


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _end_keys(ws: list[bytes]) -> list[int]:
    """Hashes of the first and the last m words, for m of the line's own length and of one word less."""
    out = {}
    for n in (len(ws), len(ws) - 1):
        m = ENDS[bisect_right(ENDS, n // 2) - 1]
        if m not in out:
            out[m] = [_long(xxhash.xxh64_intdigest(b" ".join(x), 2 * m + k)) for k, x in enumerate((ws[:m], ws[-m:]))]
    return [k for ks in out.values() for k in ks]


def variant_keys(ws: list[bytes]) -> tuple[int, np.ndarray]:
    """The key of a line and of each variant with one word left out: a polynomial in the hashes of the words, modulo
    2^64, so that prefix sums give all variants in time linear in the line."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in ws], dtype=np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), _BASE)]), dtype=np.uint64)
        before = np.cumsum(h * power[:-1], dtype=np.uint64)
        after = np.cumsum(h[1:] * power[:-2], dtype=np.uint64)  # words after the first, each one place earlier
        less = np.concatenate([[np.uint64(0)], before[:-1]]) + np.concatenate([after[-1:] - np.concatenate([[np.uint64(0)], after[:-1]]), [np.uint64(0)]]) if len(h) > 1 else np.zeros(1, dtype=np.uint64)
    return int(before[-1:].view(np.int64)[0]), less.view(np.int64)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, own (hash of the text), no, h1, h2 (128-bit hash), ends (none for short lines) of all lines with a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("lines")  # drops those of other operators
        for pdf in batches:
            rows = []
            for doc, own, text in zip(pdf["doc_id"], pdf["own"], pdf["text"], strict=True):
                for no, line in enumerate(lower_bytes(text).split(b"\n")):
                    ws = line.split()
                    if ws:
                        h = xxhash.xxh128_intdigest(b" ".join(ws))
                        rows.append((doc, own, no, _long(h >> 64), _long(h & (1 << 64) - 1), _end_keys(ws) if len(ws) >= MIN_WORDS else []))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["doc_id", "own", "no", "h1", "h2", "ends"]).astype({"doc_id": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=["doc_id", "own", "no", "h1", "h2", "ends"]).astype({"doc_id": "Int64"})

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), "text")
    return texts.mapInPandas(run, "doc_id long, own long, no int, h1 long, h2 long, ends array<long>")


def _compared(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, no, own, norm, whole, less of the lines at the places (doc_id, no, own): the key of the line and of its
    variants."""
    per = cut(places.groupBy("doc_id", "own").agg(F.collect_set("no").alias("nos")))
    per = small(per.withColumnsRenamed({"doc_id": "d", "own": "o"}), MAX_KEYS, F.size("nos"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), "text")
    texts = texts.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("own") == F.col("o"))).select("doc_id", "own", "text", "nos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for doc, own, text, nos in zip(pdf["doc_id"], pdf["own"], pdf["text"], pdf["nos"], strict=True):
                parts = lower_bytes(text).split(b"\n")
                for no in nos.tolist():
                    ws = parts[no].split()
                    whole, less = variant_keys(ws)
                    rows.append((doc, no, own, b" ".join(ws).decode(), whole, less))
                    held += len(ws)
                if held > 200_000:
                    yield pd.DataFrame(rows, columns=["doc_id", "no", "own", "norm", "whole", "less"]).astype({"doc_id": "Int64"})
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "no", "own", "norm", "whole", "less"]).astype({"doc_id": "Int64"})

    return texts.mapInPandas(run, "doc_id long, no int, own long, norm string, whole long, less array<long>")


def within_one_edit(a: list[str], b: list[str]) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def near_dropped(compared: DataFrame) -> DataFrame:
    """The places of the lines of compared of which an earlier one is one edit away. compared has each place once, so
    that the joins to it are plain ones, which Spark can split where many lines share an earliest partner."""

    @F.pandas_udf("boolean")
    def one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype=bool)

    place = F.struct(*PLACE)
    less = compared.select(place.alias("place"), F.posexplode("less").alias("pos", "k"))
    whole = compared.select(place.alias("place"), F.col("whole").alias("k"))
    # one word replaced: both leave out the same place; the earliest of each group will do, as all in it are one edit apart
    groups = less.groupBy("k", "pos").agg(F.min("place").alias("m"), F.count("*").alias("c")).where("c > 1").select("k", "pos", "m")
    pairs = less.join(small(cut(groups), MAX_KEYS), ["k", "pos"]).select("place", "m")
    # one word more or less: the shorter line is the variant of the longer
    both = less.select("k", F.col("place").alias("long")).join(small(whole.select("k", F.col("place").alias("short")), MAX_KEYS), "k")
    both = cut(both.select("long", "short"))
    pairs = pairs.unionByName(both.select(F.col("long").alias("place"), F.col("short").alias("m")))
    pairs = pairs.unionByName(both.groupBy("short").agg(F.min("long").alias("m")).select(F.col("short").alias("place"), "m"))
    pairs = cut(pairs.where("m < place").distinct())
    norm = compared.select(place.alias("p"), "norm")
    own = pairs.join(norm.withColumnsRenamed({"p": "place", "norm": "a"}), "place")
    return own.join(norm.withColumnsRenamed({"p": "m", "norm": "b"}), "m").where(one_edit("a", "b")).select("place").distinct()


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, own, no of every line that goes."""
    place = F.struct(*PLACE)
    all_ = cut(lines(docs))
    first = cut(all_.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c"), F.first("ends").alias("ends")))
    keys = first.select("h1", "first", F.explode("ends").alias("end"))
    shared = keys.groupBy("end").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("end")
    near = keys.join(small(cut(shared), MAX_KEYS), "end", "left_semi").select("first.*").distinct()
    gone = near_dropped(cut(_compared(docs, near).dropDuplicates(list(PLACE)))).select(F.col("place").alias("first"), F.lit(True).alias("gone"))
    repeated = first.select("h1", "h2", "first", "c").join(small(cut(gone), MAX_KEYS), "first", "left").where("c > 1 or gone")
    hits = all_.select(*PLACE, "h1", "h2").join(repeated, ["h1", "h2"]).where(F.col("gone").isNotNull() | (place != F.col("first")))
    return hits.select(*PLACE)


def parted(docs: DataFrame) -> DataFrame:
    """_row (a row of docs), _text (its text freed of the lines that go) and _n (how many go)."""
    per = dropped_lines(docs).groupBy("doc_id", "own").agg(F.collect_set("no").alias("nos"))
    per = per.withColumnsRenamed({"doc_id": "_doc", "own": "_own"})
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("_row.text") == F.col("_own"))
    joined = held.join(per, same, "left")
    kept = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "nos"), lambda i: F.get(ls, i))
    left = let(F.split("_row.text", "\n"), kept)
    text = F.when(F.col("nos").isNull(), F.col("_row.text")).otherwise(F.array_join(left, "\n"))
    return joined.select("_row", text.alias("_text"), F.when(F.col("nos").isNull(), F.lit(0)).otherwise(F.size("nos")).cast("long").alias("_n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs with their text freed of the lines that go, and n_dropped."""
    others = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("doc_id", "text", "n_dropped")]
    return parted(docs).select(F.col("_row.doc_id").alias("doc_id"), F.col("_text").alias("text"), *others, F.col("_n").alias("n_dropped"))


def oracle_sql(documents: str = "documents") -> str:
    """doc_id, n_dropped, n_chars, text_sha256 in DuckDB's SQL, for tables whose ids are unique: variants are compared as texts."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with raw as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from {documents}),
l as (select *, list_filter(regexp_split_to_array(translate(line, '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from raw),
e as (select doc_id, no, w, len(w) as n, array_to_string(w, ' ') as norm from l where len(w) > 0),
f0 as (select norm, min((doc_id, no)) as place, any_value(w) as w, any_value(n) as n from e group by norm),
f as (select *, row_number() over (order by place) as r from f0 where n >= {MIN_WORDS}),
v as (select norm, r, n, p, array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ') as v from f, unnest(range(1, n + 1)) u(p)),
gone as (select a.norm from v a join (select v, p, n, min(r) as m from v group by all) b using (v, p, n) where b.m < a.r
  union select a.norm from v a join f on f.norm = a.v where f.r < a.r
  union select f.norm from f join (select v, min(r) as m from v group by v) b on b.v = f.norm where b.m < f.r),
d as (select doc_id, no from e join f0 using (norm) where (doc_id, no) <> place or norm in (select norm from gone)),
k as (select l.doc_id, coalesce(string_agg(line, chr(10) order by l.no) filter (d.no is null), '') as text, count(d.no) as n_dropped from l left join d on d.doc_id = l.doc_id and d.no = l.no group by l.doc_id)
select t.doc_id, coalesce(n_dropped, 0) as n_dropped, cast(length(k.text) as bigint) as n_chars, sha256(k.text) as text_sha256 from {documents} t left join k using (doc_id)"""
