"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by its content (SHA-256). The ledger lists which blobs have been scanned
under which version of the rules, a hash of them; only unseen (blob, rule version) pairs are scanned, each blob once however many paths or
versions hold it, and findings join back to all of them. All of it is DataFrame expressions.

A rule's spans come from one pass of its pattern: matches are fenced with a private-use character that the text is
first freed of (swapped for another one of the same length), the fenced text is split, and running lengths give the
positions in code points.

Defined results: null text is an empty blob without findings; rows stay as they are, repeated rows and null ids
too; further columns are not read; a blob without findings has an empty array of spans, never a missing row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

FENCE, SWAP = "\ue000", "\ue001"
#: Pieces of a fenced text whose spans are gathered at once; even.
CHUNK = 512
SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """pattern: a Java regular expression. keep: of a match, the group that must have at_least characters."""

    kind: str
    pattern: str
    at_least: int = 0
    group: int = 0
    base: bool = True


# The base kinds in their order, then kinds added here (public token formats).
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", base=False),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{3,128}@", base=False),
)


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """A version that changes whenever a rule does."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _spans(text: Column, n: int, rule: Rule) -> Column:
    """Spans of one rule as an array of (start, kind, end), in order."""
    if rule.at_least and not rule.group:
        cheap = re_quantified(rule)
    else:
        cheap = rule.pattern
    fenced = F.regexp_replace(text, cheap, f"{FENCE}$0{FENCE}")
    none = F.array().cast(SPANS)

    def take(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.char_length(piece)
        held = F.regexp_extract(piece, rule.pattern, rule.group) if rule.group else piece
        good = acc["inside"] & (F.char_length(held) >= rule.at_least)
        one = F.array(F.struct(acc["at"].alias("start"), F.lit(n).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def found(pieces: Column) -> Column:
        """Appending copies an array, so spans are gathered in chunks of pieces, each of which knows where it starts."""
        chunk = lambda i: F.slice(pieces, i * CHUNK + 1, F.lit(CHUNK))
        chunks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int"))
        lengths = F.transform(chunks, lambda i: F.aggregate(chunk(i), F.lit(0), lambda a, p: a + F.char_length(p)))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        # a chunk has an even number of pieces, so that it starts outside of a match
        first = lambda at: F.struct(at.alias("at"), F.lit(False).alias("inside"), none.alias("out"))
        return let(starts, lambda s: F.flatten(F.transform(chunks, lambda i: F.aggregate(chunk(i), first(F.get(s, i)), take, lambda acc: acc["out"]))))

    return F.when(F.contains(fenced, F.lit(FENCE)), let(F.split(fenced, FENCE), found)).otherwise(none)


def re_quantified(rule: Rule) -> str:
    """The pattern whose matches are those of a rule that ends in one character class, if long enough: as many of the
    class are asked for at once, which leaves short runs unfenced. The match is the rest of a run either way."""
    fixed = 4 if rule.pattern.startswith("AKIA") else 0
    return rule.pattern.removesuffix("+") + f"{{{rule.at_least - fixed},}}"


def _scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    text = F.translate(F.coalesce("text", F.lit("")), FENCE, SWAP)
    found = let(text, lambda t: F.concat(*[_spans(t, n, r) for n, r in enumerate(rules)]))
    return blobs.select("blob", F.array_sort(found).alias("spans"))


def find_secrets(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans: one row for each row of blobs (blob, text) in which a rule finds something."""
    return _scanned(blobs, rules).where(F.size("spans") > 0)


def unseen(versions: DataFrame, ledger: DataFrame | None, version: str) -> DataFrame:
    """blob, text of each distinct blob among versions that the ledger has not under this rule version."""
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = blobs.dropDuplicates(["blob"])  # copies go before the shuffle that the ledger's join shares
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == version).select("blob").distinct(), "blob", "left_anti")
    return blobs


def scan(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """The new rows of the ledger (blob, rule_version) and of the findings (blob, rule_version, spans).

    Both come from one pass, written once, so that the join back to the paths is one that Spark can split where a blob is
    hot. versions: (path, version, text) or more columns; only text is read here. findings: those of earlier scans; given,
    the second result holds them too."""
    version = rule_version(rules)
    new = cut(_scanned(unseen(versions, ledger, version), rules).select("blob", F.lit(version).alias("rule_version"), "spans"))
    found = new.where(F.size("spans") > 0)
    return new.select("blob", "rule_version"), found if findings is None else findings.unionByName(found)


def by_path(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, spans of every version, through its blob."""
    own = versions.select("doc_id", blob_id(F.col("text")).alias("blob"))
    got = findings.where(F.col("rule_version") == rule_version(rules)).select("blob", "spans")
    return own.join(got, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan_arrivals(versions: DataFrame, arrival: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """by_path() of all versions, scanned as they come in: those with the least value of the column `arrival` first, then
    all, of which the ledger knows the former blobs and only the others are scanned."""
    least = versions.agg(F.min(arrival)).first()[0]
    ledger, found = scan(versions.where(F.col(arrival) == F.lit(least)), rules=rules)
    _, found = scan(versions, ledger, found, rules)
    return by_path(versions, found, rules)


def digests(per_path: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<base kind> counts, base_sha256 and spans as text, of by_path()."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    n_base = sum(r.base for r in rules)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    return per_path.select(
        "doc_id",
        *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(rules) if r.base],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < n_base)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def oracle_sql(documents: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The digests in DuckDB's SQL, rule by rule on every text."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    one = []
    for n, r in enumerate(rules):
        held = f"regexp_extract(piece, {quote(r.pattern)}, {r.group})" if r.group else "piece"
        one.append(f"""select key, {n} as kind, {quote(r.kind)} as name, {r.base} as base, sum_before as a, sum_before + length(piece) as b from (
  select key, piece, k, sum(length(piece)) over (partition by key order by k) - length(piece) as sum_before from (
    select key, unnest(ps) as piece, generate_subscripts(ps, 1) as k from (select key, string_split(regexp_replace(t, {quote(r.pattern)}, chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) as ps from d) where len(ps) > 1))
  where k % 2 = 0 and length({held}) >= {r.at_least}""")
    text = "name || ':' || a || ':' || b"
    counts = ", ".join(f"count(s.kind) filter (kind = {n}) as n_{r.kind}" for n, r in enumerate(rules) if r.base)
    return f"""
with d as (select row_number() over () as key, doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) as t from {documents}),
s as ({' union all '.join(one)})
select d.doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' order by a, kind) filter (base), '')) as base_sha256, coalesce(string_agg({text}, ',' order by a, kind) , '') as spans from d left join s using (key) group by d.key, d.doc_id"""
