"""Benchmark decontamination by spaced-seed hashing.

A mask such as 111011 reads five of six neighbouring tokens and ignores the fourth. Training and test hashes under the
same mask are joined; each hit fixes an alignment (document, item, offset) along which the item's tokens are compared.
An item is found where, on some alignment, a window of WINDOW tokens (the whole item, if it is shorter) has at least
SIMILARITY of its tokens equal. The three masks hit every such window of a whole item of 8 tokens or more, wherever its
substitutions lie (a test tries all of them), so no overlap is missed. All of it is DataFrame expressions.

Tokens are words in lower-case A-Z freed of common punctuation. Items of 5 to 7 tokens must occur unchanged; shorter
ones are never found.

Defined results: null or empty texts contain nothing and null or empty items are in nothing; every row of documents
gives a row, repeated rows and null ids too; repeated items are found together; an item's id may be null and is then
counted, not listed. Seeds and hits are broadcast only up to a counted number of rows and joined by shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, lower_ascii, small, words

MASKS = ("11111", "111011", "11010011")
WINDOW, SIMILARITY, LEAST = 15, 0.8, 8
#: Rows that may be broadcast: 24 bytes each, so that a broadcast stays below some 100 MB.
MAX_SEEDS = MAX_HITS = 2_000_000
#: Tokens of items that may be broadcast, of some 10 bytes.
MAX_ITEM_TOKENS = 5_000_000

PUNCTUATION = ".,;:!?\"'()[]{}"


def tokens(text: Column) -> Column:
    return words(F.translate(lower_ascii(text), PUNCTUATION, ""))


def seeds(rows: DataFrame, w: Column, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """The columns of rows with pos and hash of every mask and position of the token array w; the mask is part of the
    hash. Words are hashed once. Positions are exploded before the masks, so that hashes are computed on columns in
    generated code and no arrays of them are built."""
    least = min(map(len, masks))
    hashed = rows.select("*", let(w, lambda a: F.transform(a, lambda x: F.xxhash64(x))).alias("_h")).where(F.size("_h") >= least)
    placed = hashed.select("*", F.explode(F.sequence(F.lit(0), F.size("_h") - least)).alias("pos"))

    def of(m: int, mask: str) -> Column:
        got = F.xxhash64(F.lit(m), *[F.get("_h", F.col("pos") + o) for o, c in enumerate(mask) if c == "1"])
        return F.when(F.col("pos") + len(mask) <= F.size("_h"), got)

    return placed.select(*rows.columns, "pos", F.explode(F.array(*[of(m, mask) for m, mask in enumerate(masks)])).alias("hash"))


def _similar(doc: Column, item: Column, offset: Column) -> Column:
    """Whether the item's tokens, laid over the document's from offset on, agree in some window."""
    n = F.size(item)
    equal = F.transform(item, lambda x, j: F.coalesce((x == F.get(doc, j + offset)).cast("int"), F.lit(0)))
    width = F.least(n, F.lit(WINDOW))
    need = F.when(n < LEAST, n).otherwise(F.ceil(width * F.lit(SIMILARITY) - F.lit(1e-9)).cast("int"))

    def slide(e: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(1), n - width + 1), lambda s: F.aggregate(F.slice(e, s, width), F.lit(0), lambda a, b: a + b))
        return F.array_max(sums) >= need

    return let(equal, slide)


def found_in_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """own (hash of a document's text), item_own (hash of an item's tokens), n of every item found in a text, n: the number
    of alignments at which it is found. Equal texts and equal items are one, so that copies hit once."""
    own = F.xxhash64(F.coalesce("text", F.lit(""))).alias("own")
    items = benchmark.select(tokens(F.col("text")).alias("item")).where(F.size("item") >= 5).select(F.xxhash64("item").alias("item_own"), "item")
    items = cut(items.dropDuplicates(["item_own"]))
    test = seeds(items, F.col("item")).where("hash is not null").select("item_own", "hash", F.col("pos").alias("item_pos"))
    test = cut(test.distinct())
    train = seeds(docs.select(own, "text"), tokens(F.col("text"))).select("own", "pos", "hash")
    hits = train.join(small(test, MAX_SEEDS), "hash").select("own", "item_own", (F.col("pos") - F.col("item_pos")).alias("offset")).distinct()
    hits = cut(hits)
    # only texts with a hit are read again, and only theirs are shuffled
    hit = small(cut(hits.select(F.col("own").alias("_hit")).distinct()), MAX_HITS)
    texts = docs.select(own, "text").join(hit, F.col("own") == F.col("_hit"), "left_semi").dropDuplicates(["own"]).select("own", tokens(F.col("text")).alias("w"))
    both = texts.join(small(hits, MAX_HITS), "own").join(small(items, MAX_ITEM_TOKENS, F.size("item")), "item_own")
    return both.where(_similar(F.col("w"), F.col("item"), F.col("offset"))).groupBy("own", "item_own").agg(F.count("*").alias("n"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """own, item_id, n: found_in_texts() by the ids of the items, repeated ids once with the sum."""
    ids = benchmark.select("item_id", F.xxhash64(tokens(F.col("text"))).alias("item_own")).distinct()
    return found_in_texts(docs, benchmark).join(ids, "item_own").groupBy("own", "item_id").agg(F.sum("n").alias("n"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, own (hash of the text), contaminated, n_items, item_ids (ascending) of every document."""
    found = overlaps(docs, benchmark).groupBy("own").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    found = cut(found)
    ids = found.schema["item_ids"].dataType
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    joined = own.join(small(found, MAX_HITS, F.size("item_ids")), "own", "left")
    return joined.select("doc_id", "own", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast(ids)).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    found = small(cut(found_in_texts(docs, benchmark).select(F.col("own").alias("_own")).distinct()), MAX_HITS)
    held = docs.select(F.struct(*docs.columns).alias("_row"))  # whatever the columns are called
    return held.join(found, F.xxhash64(F.coalesce("_row.text", F.lit(""))) == F.col("_own"), "left_anti").select("_row.*")


def oracle_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """doc_id, contaminated, n_items, item_ids in DuckDB's SQL, for tables whose ids are unique: every equal token is an alignment."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words_ = lambda c: f"list_filter(regexp_split_to_array(translate(translate(coalesce({c}, ''), '{upper}', '{upper.lower()}'), '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
with d as (select doc_id, unnest(w) as tok, generate_subscripts(w, 1) as pos from (select doc_id, {words_('text')} as w from {documents})),
i as (select item_id, len(w) as n, unnest(w) as tok, generate_subscripts(w, 1) as j from (select item_id, {words_('text')} as w from {benchmark}) where len(w) >= 5),
m as (select doc_id, item_id, any_value(n) as n, list(j) as js, count(*) as c from d join i using (tok) group by doc_id, item_id, pos - j),
q as (select *, least(n, {WINDOW}) as width, case when n < {LEAST} then n else cast(ceil(least(n, {WINDOW}) * {SIMILARITY} - 1e-9) as bigint) end as need from m),
h as (select distinct doc_id, item_id from q where c >= need and list_max(list_transform(range(1, n - width + 2), lambda s: len(list_filter(js, lambda x: x >= s and x < s + width)))) >= need),
g as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id) as item_ids from h group by doc_id)
select t.doc_id, n_items is not null as contaminated, coalesce(n_items, 0) as n_items, coalesce(item_ids, '') as item_ids from {documents} t left join g using (doc_id)"""
