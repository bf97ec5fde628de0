"""Tables of genetics that derive from the star schema: sites, likelihood observations, VCF rows, ranges, genotypes.

Each is a DataFrame and, under the same name, a DuckDB query on the same tables. Integer arithmetic makes both agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.scalars import BASES, GENOTYPES

# A pedigree of twelve (famid, pid, fatid, motid, sex; -1: founder) and a three-generation one.
PEDIGREE12 = (("F1", 0, -1, -1, 1), ("F1", 1, -1, -1, 2), ("F1", 2, 0, 1, 2), ("F1", 3, 0, 1, 1), ("F2", 4, -1, -1, 1), ("F2", 5, -1, -1, 2), ("F2", 6, 4, 5, 1), ("F2", 7, 4, 5, 1), ("U8", 8, -1, -1, 1), ("U9", 9, -1, -1, 2), ("U10", 10, -1, -1, 1), ("U11", 11, -1, -1, 2))
PEDIGREE_EXT = (("G", 0, -1, -1, 1), ("G", 1, -1, -1, 2), ("G", 2, 0, 1, 2), ("G", 3, -1, -1, 1), ("G", 4, 3, 2, 1), ("G", 5, 3, 2, 2), ("G", 6, -1, -1, 1), ("G", 7, 6, 5, 1), ("U8", 8, -1, -1, 1), ("U9", 9, -1, -1, 2), ("U10", 10, -1, -1, 1), ("U11", 11, -1, -1, 2))
SAMPLES = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pedigree(spark: SparkSession, rows=PEDIGREE12) -> DataFrame:
    return spark.createDataFrame(list(rows), "famid string, pid int, fatid int, motid int, sex int")


def pedigree_sql(rows=PEDIGREE12) -> str:
    return "select * from (values " + ", ".join(f"('{a}', {b}, {c}, {d}, {e})" for a, b, c, d, e in rows) + ") v(famid, pid, fatid, motid, sex)"


def with_site(df: DataFrame, key: str) -> DataFrame:
    """Adds site, chrom, pos, ref_base, alt_base, fpct of a site number; in plain arithmetic, so that no join is needed."""
    return df.selectExpr("*", f"{key} as site").selectExpr("*", *_SITE)


_SITE = (
    "case site % 10 when 7 then 'X' when 8 then 'Y' when 9 then 'MT' else cast(1 + (site % 10) % 3 as string) end as chrom",
    "cast(site * 10 + site % 7 as int) as pos",
    "cast(1 + site % 4 as int) as ref_base",
    "cast(case when site % 3 < 2 then case 1 + site % 4 when 1 then 3 when 2 then 4 when 3 then 1 else 2 end else case 1 + site % 4 when 1 then 2 when 2 then 1 when 3 then 2 else 1 end end as int) as alt_base",
    "cast(case when site % 6 = 0 then 0 else 10 + 10 * (site % 5) end as int) as fpct",
)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_site(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").drop("p_partkey")


SITES_SQL = "select p_partkey as site, " + ", ".join(x.replace("site", "p_partkey").replace("as string", "as varchar") for x in _SITE) + " from part"


def _is_alt(p: str, k: str) -> str:
    return f"(((site * 7919 + {p} * 1543 + {k} * 389) % 1009) % 100 < fpct)"


_FATHER, _MOTHER = "case when p < 4 then 0 else 4 end", "case when p < 4 then 1 else 5 end"
_CHILD = "p in (2, 3, 6, 7)"
#: Whether the first and the second allele of person p at a site is the alternative one.
ALT1 = f"(case when {_CHILD} then {_is_alt(f'({_FATHER})', '(1 + (site * 31 + p * 17) % 2)')} or (p = 3 and site % 97 = 5) else {_is_alt('p', '1')} end)"
ALT2 = f"(case when {_CHILD} then {_is_alt(f'({_MOTHER})', '(1 + (site * 13 + p * 29) % 2)')} else {_is_alt('p', '2')} end)"
_INDEX = "((least({a}, {b}) - 1) * (10 - least({a}, {b})) {div} 2 + greatest({a}, {b}) - least({a}, {b}))"


def _pl(a: int, b: int) -> str:
    same = f"greatest(case when a1 = {a} then 1 else 0 end + case when a2 = {b} then 1 else 0 end, case when a1 = {b} then 1 else 0 end + case when a2 = {a} then 1 else 0 end)"
    return f"least(255, 4 * depth * (2 - {same}))"


def _observations(div: str, array: str, ints: str) -> list[str]:
    """The steps from (site.., p, t) to observations, in SQL that both engines read."""
    index = lambda a, b: _INDEX.format(a=a, b=b, div=div)
    raw = ", ".join(_pl(a, b) for a, b in GENOTYPES)
    het = f"case when {index('a1', 'a2')} = {index('ref_base', 'alt_base')} then {index('ref_base', 'ref_base')} else {index('ref_base', 'alt_base')} end"
    at = (lambda k: f"raw[{k}]") if array == "array({})" else (lambda k: f"raw[({k}) + 1]")
    swap = ", ".join(f"cast(case when t % 19 = 0 and {g} = g_true then {at('g_other')} when t % 19 = 0 and {g} = g_other then {at('g_true')} else {at(g)} end as smallint)" for g in range(10))
    return [
        f"select *, cast(4 + t % 23 as int) as depth, cast(30 + t % 31 as smallint) as map_qual, case when {ALT1} then alt_base else ref_base end as a1, case when {ALT2} then alt_base else ref_base end as a2 from {{}}",
        f"select *, {array.format(raw)} as raw, cast({index('a1', 'a2')} as {ints}) as g_true, cast({het} as {ints}) as g_other from {{}}",
        f"select site, chrom, pos, ref_base, alt_base, p as sample_id, depth, map_qual, a1, a2, {array.format(swap)} as pl from {{}}",
    ]


# Alleles in which genotype g differs from the true one, by [true][g]. A table, as the same in ten expressions makes a method that Java
# never compiles.
_FAR = [[2 - max((x == a) + (y == b), (x == b) + (y == a)) for a, b in GENOTYPES] for x, y in GENOTYPES]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, chrom, pos, ref_base, alt_base, sample_id, depth, map_qual, the true alleles a1 and a2, pl[10]."""
    base = table(spark, sf_dir, "lineitem").groupBy("l_partkey", (F.col("l_orderkey") % SAMPLES).cast("int").alias("p")).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("t"))
    out = spark.sql(_observations("div", "array({})", "int")[0].format("{df}"), df=with_site(base, "l_partkey").drop("l_partkey"))
    index = lambda a, b: F.expr(_INDEX.format(a=a, b=b, div="div")).cast("int")
    het = F.when(index("a1", "a2") == index("ref_base", "alt_base"), index("ref_base", "ref_base")).otherwise(index("ref_base", "alt_base"))
    out = out.withColumns({"g_true": index("a1", "a2"), "g_other": het})
    far = F.coalesce(F.get(F.lit(_FAR), "g_true"), F.lit([2] * len(GENOTYPES)))
    pl = lambda n: F.least(F.lit(255), 4 * F.col("depth") * n).cast("smallint")
    other = lambda g: F.when(g == F.col("g_true"), F.col("g_other")).when(g == F.col("g_other"), F.col("g_true")).otherwise(g)
    swapped = F.transform(F.lit(list(range(len(GENOTYPES)))), lambda g: pl(F.get(far, other(g))))
    out = out.withColumn("pl", F.when(F.col("t") % 19 == 0, swapped).otherwise(F.transform(far, pl)))
    return out.select("site", "chrom", "pos", "ref_base", "alt_base", F.col("p").alias("sample_id"), "depth", "map_qual", "a1", "a2", "pl")


_BASE_SQL = ("select l_partkey as site, cast(l_orderkey % 12 as int) as p, min(l_orderkey * 8 + l_linenumber) as t, " + ", ".join(x.replace("site", "l_partkey").replace("as "
    "string", "as varchar") for x in _SITE) + " from lineitem group by l_partkey, l_orderkey % 12")
_s1, _s2, _s3 = _observations("//", "[{}]", "int")
#: Common table expressions: sites, obs (observations), ped (the pedigree of twelve).
WITH_OBS = f"with sites as ({SITES_SQL}), o0 as ({_BASE_SQL}), o1 as ({_s1.format('o0')}), o2 as ({_s2.format('o1')}), obs as ({_s3.format('o2')}), ped as ({pedigree_sql()})"


def gl_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations without what a reader of likelihoods can't know."""
    return observations(spark, sf_dir).drop("site", "alt_base", "a1", "a2")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n_parts"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").crossJoin(F.broadcast(n)).selectExpr("cast(1 + o_custkey % 3 as string) as chrom", "cast((o_orderkey "
        "* 37) % (10 * n_parts) as int) as beg", "cast((o_orderkey * 37) % (10 * n_parts) + 1 + o_custkey % 60 as int) as end")


RANGES_SQL = ('select cast(1 + o_custkey % 3 as varchar) as chrom, cast((o_orderkey * 37) % (10 * (select count(*) from part)) as int) as beg, cast((o_orderkey * 37) % (10 '
    '* (select count(*) from part)) + 1 + o_custkey % 60 as int) as "end" from orders')


def site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites(spark, sf_dir)
    return s.where("site % 11 = 0").select("chrom", "pos").unionByName(s.where("site % 50 = 0").select("chrom", (F.col("pos") + 3).alias("pos")))


SITE_LIST_SQL = f"select chrom, pos from ({SITES_SQL}) where site % 11 = 0 union all select chrom, pos + 3 from ({SITES_SQL}) where site % 50 = 0"


def vcf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos (1-based), id, ref, alt, qual, filter, info, format, samples array<string> of twelve samples."""
    from kinfold.functions.scalars import base_label

    ref, alt = F.col("ref_base"), F.col("alt_base")
    index = lambda a, b: F.expr(_INDEX.format(a=a, b=b, div="div"))
    # columns in steps: what is named often is computed once
    o = observations(spark, sf_dir).withColumns({f"p{k}": F.get("pl", index(*x)).cast("int") for k, x in enumerate((("ref_base", "ref_base"), ("ref_base", "alt_base"), ("alt_base", "alt_base")))})
    pl = [F.col(f"p{k}") for k in range(3)]
    best = F.when((pl[0] <= pl[1]) & (pl[0] <= pl[2]), F.lit("0/0")).when(pl[1] <= pl[2], F.lit("0/1")).otherwise(F.lit("1/1"))
    o = o.withColumns({"best": best, "second": pl[0] + pl[1] + pl[2] - F.greatest(*pl) - F.least(*pl)})
    text = F.when((F.col("site") % 31 == 0) & (F.col("sample_id") == 4), F.lit(".")).otherwise(F.concat_ws(":", "best", F.least("second", F.lit(100)), "depth", F.concat_ws(",", *pl)))
    # the site's values as minima, not keys, so that filters on them are not computed for every row of lineitem
    of_site = [F.min(c).alias(c) for c in ("chrom", "pos", "ref_base", "alt_base")]
    g = o.withColumn("text", text).groupBy("site").agg(*of_site, F.collect_list(F.struct("sample_id", "text")).alias("s"), F.sum("depth").alias("dp"))
    by_id = F.map_from_entries("s")
    samples = F.array(*[F.coalesce(F.try_element_at(by_id, F.lit(k)), F.lit("./.")) for k in range(SAMPLES)])
    alt_text = F.when(F.col("site") % 23 == 0, F.lit("A,C")).when(F.col("site") % 29 == 0, F.concat(base_label(alt), F.lit("A"))).otherwise(base_label(alt))
    info = F.concat(F.lit("DP="), F.col("dp"), F.lit(";AF=0."), F.lpad((F.col("site") % 100).cast("string"), 2, "0"), F.lit(";ANNO=intronic:G"), F.col("site") % 50, F.when(F.col("site") % 3 == 0, F.lit(";HM3")).otherwise(F.lit("")))
    return g.select("chrom", (F.col("pos") + 1).alias("pos"), F.when(F.col("site") % 2 == 0, F.concat(F.lit("rs"), F.col("site"))).otherwise(F.lit(".")).alias("id"), base_label(ref).alias("ref"), alt_text.alias("alt"), (F.col("site") % 101).cast("double").alias("qual"), F.lit("PASS").alias("filter"), info.alias("info"), F.lit("GT:GQ:DP:PL").alias("format"), samples.alias("samples"))


def _vcf_sql() -> str:
    index = lambda a, b: "pl[" + _INDEX.format(a=a, b=b, div="//") + " + 1]"
    label = lambda c: f"'{BASES}'[{c}]"
    return (f"""
v0 as (select *, cast({index('ref_base', 'ref_base')} as int) as p0, cast({index('ref_base', 'alt_base')} as int) as p1, cast({index('alt_base', 'alt_base')} as int) as p2 from obs),
v1 as (select *, case when site % 31 = 0 and sample_id = 4 then '.' else (case when p0 <= p1 and p0 <= p2 then '0/0' when p1 <= p2 then '0/1' else '1/1' end) || ':' || least(p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2), 100) || ':' || depth || ':' || p0 || ',' || p1 || ',' || p2 end as txt from v0),
v2 as (select site, chrom, pos, ref_base, alt_base, map_from_entries(list((sample_id, txt))) as s, sum(depth) as dp from v1 group by all),
vcf as (select site, chrom, pos + 1 as pos, case when site % 2 = 0 then 'rs' || site else '.' end as id, {label('ref_base')} as ref, case when site % 23 = 0 then 'A,C' when site % 29 = 0 then {label('alt_base')} || 'A' else {label('alt_base')} end as alt, cast(site % 101 as double) as qual, 'PASS' as filter, 'DP=' || dp || ';AF=0.' || lpad(cast(site % 100 as varchar), 2, '0') || ';ANNO=intronic:G' || (site % 50) || case when site % 3 = 0 then ';HM3' else '' end as info, 'GT:GQ:DP:PL' as format, list_transform(range(12), lambda k: coalesce(s[k::int], './.')) as samples from v2)""")


#: WITH_OBS and vcf (with the site number).
WITH_VCF = WITH_OBS + "," + _vcf_sql()


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """marker, famid, pid, a1, a2 as base codes: true pairs; at some markers child 2 has a base that no parent has."""
    o = observations(spark, sf_dir).join(F.broadcast(pedigree(spark)), F.col("sample_id") == F.col("pid"))
    other = F.expr("case when ref_base in (1, 2) and alt_base in (1, 2) then 4 when ref_base <> 1 and alt_base <> 1 then 1 else 2 end")
    broken = (F.col("site") % 53 == 7) & (F.col("pid") == 2)
    return o.select(F.col("site").alias("marker"), "chrom", "famid", "pid", F.when(broken, other).otherwise(F.col("a1")).cast("int").alias("a1"), F.col("a2").cast("int").alias("a2"))


GENOTYPES_SQL = ("select site as marker, chrom, famid, pid, cast(case when site % 53 = 7 and pid = 2 then case when ref_base in (1, 2) and alt_base in (1, 2) then 4 when ref_base "
    "<> 1 and alt_base <> 1 then 1 else 2 end else a1 end as int) as a1, cast(a2 as int) as a2 from obs join ped on sample_id = pid")
WITH_GENO = WITH_OBS + f", geno as ({GENOTYPES_SQL})"


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """famid, pid, trait, value: customers' balances in whole hundreds, so that ties occur; some are missing."""
    return table(spark, sf_dir, "customer").selectExpr("concat('C', c_custkey % 50) as famid", "c_custkey as pid", "cast(c_nationkey as int) as trait", "case when c_custkey "
        "% 17 = 0 then null else cast(floor(c_acctbal / 100) as double) end as value")


TRAITS_SQL = "select 'C' || (c_custkey % 50) as famid, c_custkey as pid, cast(c_nationkey as int) as trait, case when c_custkey % 17 = 0 then null else cast(floor(c_acctbal / 100) as double) end as value from customer"


def alleles(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(b) for b in BASES]), c)
