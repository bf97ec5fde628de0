"""Quality rules: a decision list learned by sequential covering, applied as one Spark conditional expression.

Statistics of every text are DataFrame expressions. A bounded sample of labelled rows (`MAX_FIT_ROWS`) is brought to
the driver as numbers alone. There rules for the bad class are grown one threshold at a time by information gain on
two thirds of the sample, pruned on the other third, and accepted while they stay precise; each next rule is
learned on what the former ones leave. The list becomes CASE WHEN rule 1 THEN ... WHEN rule 2 ... ELSE keep.

Defined results: null text has no words; a text without words has all statistics 0 and fails the base test; without
labelled rows of both classes the list is empty and the verdict is "keep"; a labelled id counts once in the fit; rows
stay as they are, repeated rows and null ids too; equal gains go to the earlier statistic, and of its
thresholds from below to the highest, which rejects least.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: At most so many labelled rows are fitted on: those with the least hash of their id.
MAX_FIT_ROWS = 20_000
#: Thresholds tried for each statistic: half way up from so many quantiles of the sample, and of its distinct values.
N_CUTS = 24
MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PRECISION = 12, 4, 12, 0.97

FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "upper_share", "digit_share", "exclaim_per_word", "dup_line_share", "repeat_share", "distinct_share", "words_per_line")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float


def _count(c: Column, chars: str) -> Column:
    """How many of the characters a text has."""
    return (F.char_length(c) - F.char_length(F.translate(c, chars, ""))).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more. Windows are compared by a 64-bit hash of their words;
    sorting replaces counting, so that the work is n log n in the words of a text however many windows repeat."""

    def some(g: Column) -> Column:
        """g: the windows' hashes in order. Only texts with a repeated window pay for the positions."""
        placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def cover(s: Column) -> Column:
            near = lambda i, d: F.coalesce(F.get(s, i + d)["h"], F.lit(None))
            dup = F.filter(s, lambda x, i: F.coalesce(near(i, -1) == x["h"], F.lit(False)) | F.coalesce(near(i, 1) == x["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(dup, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(placed, cover))

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(grams, some)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the rules' statistics."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of(t: Column) -> Column:
        def with_words(w: Column) -> Column:
            lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"[\x20\x09-\x0D]+", "") != "")
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
                _count(t, "#*$%&|<>").alias("n_symbols"),
                let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(F.array_distinct(w)).cast("long").alias("distinct"),
                (F.char_length(t) - F.char_length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long").alias("upper"),
                _count(t, "0123456789").alias("digits"),
                _count(t, "!").alias("exclaims"),
            )

        return let(words(t), with_words)

    s = docs.select("doc_id", let(text, of).alias("s")).select("doc_id", "s.*").select("*", "l.*")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).cast("double")
    return s.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("dup").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "n_words").alias("symbols_per_word"),
        share("upper", "word_chars").alias("upper_share"), share("digits", "word_chars").alias("digit_share"),
        share("exclaims", "n_words").alias("exclaim_per_word"), share("dup", "lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("distinct", "n_words").alias("distinct_share"),
        share("n_words", "lines").alias("words_per_line"),
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_FIT_ROWS) -> DataFrame:
    """Statistics and bad (1 for quality 0) of at most `limit` labelled ids, each once: with its least quality and the least
    of its rows' statistics. That bound makes the broadcast one."""
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    once = statistics(picked).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x"))
    return once.join(F.broadcast(ids), "doc_id").select("x.*", (F.col("quality") == 0).cast("int").alias("bad"))


def learn(rows: list[tuple[float, ...]], bad: list[int]) -> list[tuple[Condition, ...]]:
    """The ordered rules for the bad class. Sets of rows are the bits of integers, so that coverage is a popcount."""
    n = len(rows)
    is_bad = sum(1 << i for i, b in enumerate(bad) if b)
    everything = (1 << n) - 1
    if not is_bad or is_bad == everything:
        return []
    prune_set = sum(1 << i for i in range(2, n, 3))
    candidates: list[tuple[Condition, int]] = []
    for k, feature in enumerate(FEATURES):
        values = sorted(r[k] for r in rows)
        distinct = sorted(set(values))
        at_ = lambda v, q: v[min(len(v) - 1, len(v) * q // (N_CUTS + 1))]
        cuts = {at_(v, q) for v in (values, distinct) for q in range(1, N_CUTS + 1)}
        higher = dict(zip(distinct, distinct[1:], strict=False))
        for t in sorted((c + higher.get(c, c)) / 2 for c in cuts):
            over = sum(1 << i for i, r in enumerate(rows) if r[k] > t)
            candidates += [(Condition(feature, True, t), over), (Condition(feature, False, t), everything & ~over)]

    def counts(s: int) -> tuple[int, int]:
        p = (s & is_bad).bit_count()
        return p, s.bit_count() - p

    def cover(rule: list[tuple[Condition, int]], within: int) -> int:
        for _, s in rule:
            within &= s
        return within

    found, left = [], everything
    while len(found) < MAX_RULES and counts(left)[0]:
        grow, prune = left & ~prune_set, left & prune_set
        rule: list[tuple[Condition, int]] = []
        at = grow
        while len(rule) < MAX_CONDITIONS:
            p0, n0 = counts(at)
            if not n0 or not p0:
                break
            gain, choice = 0.0, None
            for c in candidates:
                p, q = counts(at & c[1])
                g = p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                tie = choice is not None and abs(g - gain) <= 1e-9 and c[0].above and choice[0].feature == c[0].feature and choice[0].above
                if g > gain + 1e-9 or tie:  # of equal thresholds from below, the one that rejects least
                    gain, choice = g, c
            if choice is None:
                break
            rule.append(choice)
            at &= choice[1]
        worth = lambda r: (lambda p, q: (p - q) / (p + q) if p + q else -1.0)(*counts(cover(r, prune)))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        taken = cover(rule, left) if rule else 0
        p, q = counts(taken)
        if p + q < min(MIN_COVER, n) or p < MIN_PRECISION * (p + q):
            break
        found.append(tuple(c for c, _ in rule))
        left &= ~taken
    return found


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_FIT_ROWS) -> list[tuple[Condition, ...]]:
    rows = sorted(tuple(map(float, r)) for r in labelled_sample(docs, labels, limit).collect())
    return learn([r[:-1] for r in rows], [int(r[-1]) for r in rows])


def expression(rules: list[tuple[Condition, ...]]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for c in rule:
            holds &= F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """The statistics of every text, rule (the first that rejects it, 0: none) and kept."""
    return statistics(docs).withColumn("rule", expression(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
