"""All registered queries of the genetics library, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import codons
from kinfold.functions import scalars as S
from kinfold.functions.lineage import new_folder
from kinfold.jobs import calling, fixed, wide
from kinfold.operators import markers as M
from kinfold.operators import pedigrees as P
from kinfold.operators import ranges as R
from kinfold.operators import reads
from kinfold.operators import vcf as V
from kinfold.sources import binary as B
from kinfold.sources import fixtures as X
from kinfold.sources import text as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "family_calls_fixed"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TS = "case {0} when 1 then 3 when 2 then 4 when 3 then 1 when 4 then 2 end"
_TV1 = "case {0} when 1 then 2 when 2 then 1 when 3 then 2 when 4 then 1 end"
_TV2 = "case {0} when 1 then 4 when 2 then 3 when 3 then 4 when 4 then 3 end"
_ORDER = "case chrom when 'X' then 23 when 'Y' then 24 when 'MT' then 25 else cast(chrom as int) end"
_IDX = "((least({0}, {1}) - 1) * (10 - least({0}, {1})) // 2 + greatest({0}, {1}) - least({0}, {1}))"
FILTERS = calling.Options(min_depth=120, max_depth=250, min_map_quality=44, min_percent_with_data=80)


@query(f"with sites as ({X.SITES_SQL}) select site, cast({_IDX.format('ref_base', 'alt_base')} as int) as genotype, 'ACGT'[ref_base] as ref, {_TS.format('ref_base')} as ts, {_TV1.format('ref_base')} "
    f"as tv1, {_TV2.format('ref_base')} as tv2, alt_base = {_TS.format('ref_base')} as is_ts, case when chrom in ('X', 'Y', 'MT') then chrom else 'autosome' end as klass, {_ORDER} "
    f"as chrom_order from sites")
def site_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.sites(spark, sf_dir)
    ref = F.col("ref_base")
    return s.select("site", S.genotype_index(ref, F.col("alt_base")).alias("genotype"), S.base_label(ref).alias("ref"), S.transition(ref).alias("ts"), S.transversion1(ref).alias("tv1"), S.transversion2(ref).alias("tv2"), S.is_transition(ref, F.col("alt_base")).alias("is_ts"), S.chrom_class(F.col("chrom")).alias("klass"), S.chrom_order(F.col("chrom")).alias("chrom_order"))


@query(f"with sites as ({X.SITES_SQL}) select site, round(pow(10.0, -least(fpct * 4, 255) / 10.0), 9) as lk, cast(trunc(fpct / 7.0 * 10) as int) as pl, case when fpct / 71.0 "
    f"> 0.9999999999 then 100 else cast(floor(-10 * log10(1 - fpct / 71.0) + 0.5) as int) end as gq, round(0.5 * (1 - exp(-2 * fpct / 100.0)), 9) as haldane, round(0.5 * (exp(4 "
    f"* fpct / 100.0) - 1) / (exp(4 * fpct / 100.0) + 1), 9) as kosambi, round(-0.5 * ln(1 - 2 * fpct / 200.0), 9) + 0.0 as haldane_inv, round(0.25 * ln((1 + 2 * fpct / 200.0) / "
    f"(1 - 2 * fpct / 200.0)), 9) as kosambi_inv from sites")
def scale_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fpct")
    return X.sites(spark, sf_dir).select("site", F.round(S.phred_to_likelihood(f * 4), 9).alias("lk"), S.gl_to_pl(-f / 7).alias("pl"), S.genotype_quality(f / 71).alias("gq"), F.round(S.haldane(f / 100), 9).alias("haldane"), F.round(S.kosambi(f / 100), 9).alias("kosambi"), F.round(S.haldane_distance(f / 200), 9).alias("haldane_inv"), F.round(S.kosambi_distance(f / 200), 9).alias("kosambi_inv"))


@query(X.WITH_OBS + " select chrom, pos, arg_min(ref_base, sample_id) as ref_base, cast(count(*) as int) as n_present, string_agg(sample_id || ':' || depth, ',' order by sample_id) as present from obs group by chrom, pos")
def align_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reads.align_sites(X.gl_obs(spark, sf_dir), list(range(X.SAMPLES)))
    texts = F.filter(F.transform("depths", lambda d, i: F.when(d > 0, F.concat_ws(":", i, d))), lambda x: x.isNotNull())
    return a.select("chrom", "pos", "ref_base", F.size(texts).alias("n_present"), F.array_join(texts, ",").alias("present"))


_STATS = ("select chrom, pos, arg_min(ref_base, sample_id) as ref_base, sum(depth) as total_depth, count(*) filter (depth > 0) as ns, count(*) filter (depth > 0) * 100.0::double "
    "/ 12 as ps, coalesce(sum(map_qual) filter (depth > 0) / count(*) filter (depth > 0), 0) as mq, sum(depth) / count(*) filter (depth > 0) as avg_depth from obs group by chrom, "
    "pos")


@query(X.WITH_OBS + f" select chrom, pos, ref_base, cast(total_depth as bigint) as total_depth, ns, round(ps, 6) as ps, round(mq, 6) as mq, round(avg_depth, 6) as avg_depth from ({_STATS})")
def site_read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reads.site_read_stats(X.gl_obs(spark, sf_dir), X.SAMPLES)
    return s.select("chrom", "pos", "ref_base", "total_depth", "ns", *[F.round(c, 6).alias(c) for c in ("ps", "mq", "avg_depth")])


_REASON = (f"case when ref_base not between 1 and 4 then 'ref_base' when total_depth < {FILTERS.min_depth} then 'min_depth' when total_depth > {FILTERS.max_depth} then 'max_depth' "
    f"when ps < {FILTERS.min_percent_with_data} then 'coverage' when mq < {FILTERS.min_map_quality} then 'map_quality' end")


@query(X.WITH_OBS + f" select chrom, pos, {_REASON} as drop_reason from ({_STATS})")
def site_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reads.align_sites(X.gl_obs(spark, sf_dir), list(range(X.SAMPLES)))
    return reads.site_filters(a, X.SAMPLES, FILTERS).select("chrom", "pos", "drop_reason")


@query(X.WITH_OBS + f""", st as (select *, {_REASON} as drop_reason from ({_STATS})), j as (select st.*, alt_base, fpct, alt_base = {_TS.format('st.ref_base')} as ts from st join sites using (chrom, pos))
 select chrom, count(*) filter (ref_base between 1 and 4) as n_ref, count(*) filter (drop_reason is null and fpct = 0) as n_hom_ref, count(*) filter (drop_reason is null and fpct > 0 and ts) as n_ts, count(*) filter (drop_reason is null and fpct > 0 and not ts) as n_tv,
 {', '.join(f"count(*) filter (drop_reason = '{r}') as drop_{r}" for r in ('ref_base', 'min_depth', 'max_depth', 'coverage', 'map_quality'))}, count(*) filter (drop_reason is null) as n_kept from j group by rollup (chrom)""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = reads.site_read_stats(X.gl_obs(spark, sf_dir), X.SAMPLES)
    st = st.withColumn("drop_reason", reads.drop_reason(F.col("ref_base"), F.col("total_depth"), F.col("ps"), F.col("mq"), FILTERS))
    return reads.run_summary(st.join(X.sites(spark, sf_dir).select("chrom", "pos", "alt_base", "fpct"), ["chrom", "pos"]))


@query(f"with sites as ({X.SITES_SQL}), n as (select chrom, count(*) as n_sites from sites group by chrom) select chrom, n_sites, round(0.001 * list_sum(list_transform(range(1, "
    f"1 + case chrom when 'X' then 12 when 'Y' then 4 when 'MT' then 8 else 16 end), lambda i: 1.0 / i)), 9) as prior from n")
def founder_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.sites(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n_sites"))
    scale = {k: 0.001 * calling.prior_scale(list(X.PEDIGREE12), k) for k in ("autosome", "X", "Y", "MT")}
    return s.select("chrom", "n_sites", F.round(F.element_at(F.create_map(*[F.lit(x) for kv in scale.items() for x in kv]), S.chrom_class(F.col("chrom"))), 9).alias("prior"))


@query(X.WITH_OBS + f" select chrom, pos, cast(sum(pl[{_IDX.format('ref_base', 'ref_base')} + 1]) as bigint) as mono_pl from obs group by chrom, pos")
def mono_llk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.mono_llk(X.gl_obs(spark, sf_dir))


GRID = [0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95]


def _grid_sql() -> str:
    lk = lambda a, b: f"pow(10.0::double, -pl[{_IDX.format(a, b)} + 1] / 10.0::double)"
    terms = ", ".join(f"round(sum(log10({f * f}::double * k0 + {2 * f * (1 - f)}::double * k1 + {(1 - f) * (1 - f)}::double * k2)), 9) as l{i}" for i, f in enumerate(GRID))
    top = "greatest(" + ", ".join(f"l{i}" for i in range(len(GRID))) + ")"
    return (X.WITH_OBS + f", g as (select chrom, pos, {lk('ref_base', 'ref_base')} as k0, {lk('ref_base', 'ts')} as k1, {lk('ts', 'ts')} as k2 from (select *, {_TS.format('ref_base')} "
        f"as ts from obs)), s as (select chrom, pos, {terms} from g group by chrom, pos) select chrom, pos, case " + " ".join(f"when l{i} = {top} then {f}::double" for i, f in enumerate(GRID)) + f" "
        f"end as ref_freq, round({top}, 6) as llk from s")


@query(_grid_sql())
def grid_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.grid_mle(reads.family_grid_llk(X.gl_obs(spark, sf_dir), X.pedigree(spark), GRID), GRID)


@query(fixed.sql())
def family_calls_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed.family_calls(X.observations(spark, sf_dir), X.pedigree(spark))


@query()
def call_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calling.call_variants(X.gl_obs(spark, sf_dir), list(X.PEDIGREE12))


@query()
def call_forced_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calling.call_variants(X.gl_obs(spark, sf_dir), list(X.PEDIGREE12), forced=X.site_list(spark, sf_dir))


@query()
def call_extended_pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calling.call_variants(X.gl_obs(spark, sf_dir), list(X.PEDIGREE_EXT), calling.Options(quick_call=True))


@query()
def denovo_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calling.call_denovo(X.gl_obs(spark, sf_dir), list(X.PEDIGREE12), calling.Options(denovo=True, rate_denovo=1.5e-7))


@query()
def refine_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calling.refine_vcf(X.vcf_rows(spark, sf_dir), [str(i) for i in range(X.SAMPLES)], list(X.PEDIGREE12))


_INFO = "list_filter(string_split(info, ';'), lambda p: p <> '')"


@query(X.WITH_VCF + """ select chrom, pos, cast(regexp_extract(info, '(^|;)DP=([^;]*)', 2) as int) as dp, regexp_extract(info, '(^|;)ANNO=([^;]*)', 2) as anno, case when regexp_matches(info, '(^|;)HM3(;|$)') then '' end as hm3, list_position(string_split(format, ':'), 'DP')::int - 1 as dp_at, -1 as gl_at from vcf""")
def vcf_info_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.vcf_rows(spark, sf_dir)
    return v.select("chrom", "pos", V.info_value("DP").cast("int").alias("dp"), V.info_value("ANNO").alias("anno"), V.info_value("HM3").alias("hm3"), S.format_index(F.col("format"), "DP").alias("dp_at"), S.format_index(F.col("format"), "GL").alias("gl_at"))


_GT = "list_transform(samples, lambda s: string_split(s, ':')[1])"
_DOS = f"list_transform({_GT}, lambda g: case when regexp_full_match(g, '[0-9][/|][0-9]') then g[1]::int + g[3]::int when regexp_full_match(g, '[0-9]') then g::int else -9 end)"
_COUNTS = f"select *, list_sum(list_filter(dos, lambda d: d >= 0)) as acn, len(list_filter(dos, lambda d: d >= 0)) * 2 as ann from (select *, {_DOS} as dos from vcf)"


@query(X.WITH_VCF + f" select chrom, pos, coalesce(acn, 0)::int as ac, ann::int as an, (12 - ann / 2)::int as n_missing, round(case when ann > 0 then acn / ann else 0 end, "
    f"9) as af, least(coalesce(acn, 0), ann - coalesce(acn, 0))::int as mac from ({_COUNTS})")
def vcf_allele_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.allele_counts(X.vcf_rows(spark, sf_dir)).select("chrom", "pos", "ac", "an", "n_missing", F.round("af", 9).alias("af"), "mac")


@query(X.WITH_VCF + """ select chrom, pos, k as sample, gt, case when regexp_full_match(gt, '[0-9][/|][0-9]') then gt[1]::int + gt[3]::int else -9 end as dosage, try_cast(gt[1] as int) as a1, try_cast(nullif(gt[3], '') as int) as a2, contains(gt, '|') as phased, not regexp_matches(gt, '[/|]') as haploid, contains(gt, '.') as missing
 from (select chrom, pos, k::int as k, coalesce(nullif(string_split(samples[k + 1], ':')[1], ''), '.') as gt from vcf, unnest(range(12)) r(k))""")
def vcf_genotype_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.vcf_rows(spark, sf_dir).select("chrom", "pos", F.posexplode(V.sample_values("GT")).alias("sample", "gt"))
    gt = F.coalesce("gt", F.lit("."))
    return v.select("chrom", "pos", "sample", gt.alias("gt"), S.gt_dosage(gt).alias("dosage"), S.gt_allele(gt, 1).alias("a1"), S.gt_allele(gt, 2).alias("a2"), S.is_phased(gt).alias("phased"), S.is_haploid(gt).alias("haploid"), S.is_missing_gt(gt).alias("missing"))


@query(X.WITH_VCF + f""" select chrom, pos, ref, alt, length(ref) > 1 or length(alt) > 1 as indel from ({_COUNTS}) where alt not like '%,%' and ref <> alt and floor(qual) >= 20
 and cast(regexp_extract(info, 'DP=([0-9]+)', 1) as int) between 100 and 220 and cast(regexp_extract(info, 'AF=([0-9.]+)', 1) as double) between 0.1 and 0.9 and least(acn, ann - acn) >= 2 and acn > 0 and regexp_matches(info, 'ANNO=[^;]*G[1-4]')""")
def vcf_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.filter_site_quality(V.filter_biallelic(X.vcf_rows(spark, sf_dir)), 20)
    v = V.filter_annotation(V.filter_site_freq(V.filter_site_depth(v, 100, 220), 0.1, 0.9), "G[1-4]")
    return V.filter_variant_sites(V.filter_site_mac(v, 2)).select("chrom", "pos", "ref", "alt", V.is_indel().alias("indel"))


@query(X.WITH_VCF + f" select chrom, pos, acn / ann > 0.3 as common from ({_COUNTS}) where ann > 0 and acn / ann between 0.25 and 0.75 and list_sum(list_transform(samples, "
    f"lambda s: coalesce(try_cast(string_split(s, ':')[3] as int), 0))) >= 150")
def vcf_extract_by_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.filter_site_depth(X.vcf_rows(spark, sf_dir), 150, 0, from_info=False)
    return V.allele_counts(V.filter_site_freq(v, 0.25, 0.75, from_info=False)).select("chrom", "pos", (F.col("af") > 0.3).alias("common"))


@query(X.WITH_VCF + " select chrom, pos, array_to_string([samples[3], samples[6], samples[12]], ' ') as samples from vcf")
def vcf_select_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = V.select_samples(X.vcf_rows(spark, sf_dir), [f"s{i}" for i in range(12)], include=["s11", "s2", "s5", "s7"], exclude=["s7"])
    return rows.select("chrom", "pos", F.array_join("samples", " ").alias("samples"))


@query(X.WITH_VCF + """ select chrom || chr(9) || pos || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || printf('%.2f', qual) || chr(9) || filter || chr(9) || info || chr(9) || format || chr(9) || array_to_string(samples, chr(9)) as value from vcf""")
def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.to_lines(X.vcf_rows(spark, sf_dir))


@query("select c_custkey as ord, coalesce((select arg_max('R' || o_orderkey, o_orderkey) from orders where o_custkey = c_custkey), 'C' || c_custkey) as name from customer")
def rename_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("C"), "c_custkey").alias("name"))
    renamed = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), F.concat(F.lit("C"), "o_custkey").alias("old"), F.concat(F.lit("R"), "o_orderkey").alias("new"))
    return V.rename_samples(names, renamed)


_MERGED = f"""rg as ({X.RANGES_SQL}), w1 as (select distinct chrom, beg, "end" from rg), w2 as (select *, max("end") over (partition by chrom order by beg, "end" rows between unbounded preceding and 1 preceding) as reach from w1),
w3 as (select *, sum(case when reach is null or beg > reach then 1 else 0 end) over (partition by chrom order by beg, "end" rows unbounded preceding) as g from w2), merged as (select chrom, min(beg) as beg, max("end") as "end" from w3 group by chrom, g)"""


@query(f"with {_MERGED} select * from merged")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_ranges(X.ranges(spark, sf_dir), slice_width=4096)


@query(f"with {_MERGED}, sites as ({X.SITES_SQL}) select site, s.chrom, pos from sites s where exists (select 1 from merged m where m.chrom = s.chrom and s.pos >= m.beg and s.pos < m.\"end\")")
def sites_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sites_in_ranges(X.sites(spark, sf_dir).select("site", "chrom", "pos"), X.ranges(spark, sf_dir))


@query(f"with rg as (select row_number() over (order by o_orderkey) as ord_, * from (select o_orderkey, cast(1 + o_custkey % 3 as varchar) as chrom, o_orderkey * 3 % 20000 "
    f"as beg, o_orderkey * 3 % 20000 + o_custkey % 40 as \"end\" from orders)), sites as ({X.SITES_SQL}) select rg.o_orderkey as ord, s.chrom, s.pos + 1 as pos from sites s join "
    f"rg on rg.chrom = s.chrom and s.pos + 1 between rg.beg and rg.\"end\"")
def region_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = X.table(spark, sf_dir, "orders").selectExpr("o_orderkey as ord", "cast(1 + o_custkey % 3 as string) as chrom", "o_orderkey * 3 % 20000 as beg", "o_orderkey * 3 % 20000 + o_custkey % 40 as end")
    return R.region_query(X.sites(spark, sf_dir).select("chrom", (F.col("pos") + 1).alias("pos")), regions).select("ord", "chrom", "pos")


@query(f"with sites as ({X.SITES_SQL}), l as ({X.SITE_LIST_SQL}) select site, chrom, pos from sites where (chrom, pos) in (select chrom, pos from l)")
def sites_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sites_in_set(X.sites(spark, sf_dir).select("site", "chrom", "pos"), X.site_list(spark, sf_dir))


@query(f"with l as ({X.SITE_LIST_SQL}) select chrom, count(distinct pos) as n from l group by chrom")
def site_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.site_count(X.site_list(spark, sf_dir))


@query(f"with sites as ({X.SITES_SQL}), l as ({X.SITE_LIST_SQL}) select chrom, pos from l except select chrom, pos from sites")
def unknown_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unknown_sites(X.site_list(spark, sf_dir), X.sites(spark, sf_dir))


@query(f"with {_MERGED} select chrom, beg, \"end\" from merged order by cast(chrom as int), beg limit 1 offset 3")
def nth_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nth_range(X.ranges(spark, sf_dir), 3)


@query("select o_orderkey, r.u as chrom_beg_end from orders, unnest(['1:' || (o_orderkey % 100 + 1) || ':' || (o_orderkey % 100 + 200), 'X:' || o_custkey || ':' || o_custkey, '2:' || o_custkey || ':536870912']) r(u)")
def parse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders")
    text = F.expr("concat('chr1:', o_orderkey % 100 + 1, '-', o_orderkey % 100 + 200, ', X:', o_custkey, ',2:', o_custkey, '-')")
    r = o.select("o_orderkey", F.explode(R.parse_ranges(text)).alias("r"))
    return r.select("o_orderkey", F.concat_ws(":", "r.chrom", "r.beg", "r.end").alias("chrom_beg_end"))


@query("select distinct cast(1 + p_partkey % 22 as varchar) as chrom, p_partkey * 10 as beg, p_partkey * 10 + p_size as \"end\" from part where p_brand in (select p_brand from part where p_size = 7)")
def gene_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.table(spark, sf_dir, "part")
    genes = p.selectExpr("p_brand as name", "concat('chr', 1 + p_partkey % 22) as chrom", "p_partkey * 10 as beg", "p_partkey * 10 + p_size as end")
    return R.gene_ranges(genes, p.where("p_size = 7").selectExpr("p_brand as name"))


# Pedigrees and markers. Pedigrees of any size derive from customers: families of ten, whose persons 0 to 3 are founders.

_PED_SQL = ("select c_custkey // 10 as fam, 'K' || (c_custkey // 10) as famid, cast(c_custkey % 10 as int) as pid, cast(case c_custkey % 10 when 4 then 0 when 5 then 0 when "
    "6 then 2 when 7 then 4 when 8 then 4 when 9 then 4 else -1 end as int) as fatid, cast(case c_custkey % 10 when 4 then 1 when 5 then 1 when 6 then 3 when 7 then 6 when 8 then "
    "6 when 9 then 6 else -1 end as int) as motid, cast(case when c_custkey % 10 in (0, 2, 4, 7, 9) then 1 else 2 end as int) as sex, c_nationkey as nation from customer")
BIG_PED_SQL = f"select famid, pid, fatid, motid, sex, nation from ({_PED_SQL}) where fam in (select fam from ({_PED_SQL}) group by fam having count(*) = 10)"
WITH_PED = f"with kp as ({BIG_PED_SQL})"


def big_pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations of ten persons for every ten customers (families of fewer are left out)."""
    spec = {"fatid": {4: 0, 5: 0, 6: 2, 7: 4, 8: 4, 9: 4}, "motid": {4: 1, 5: 1, 6: 3, 7: 6, 8: 6, 9: 6}}
    place = F.col("c_custkey") % 10
    of = lambda m: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), place.cast("int")), F.lit(-1))
    rows = X.table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 10).alias("fam"), place.cast("int").alias("pid"), of(spec["fatid"]).alias("fatid"), of(spec["motid"]).alias("motid"), F.when(place.isin(0, 2, 4, 7, 9), 1).otherwise(2).alias("sex"), F.col("c_nationkey").alias("nation"))
    full = rows.groupBy("fam").agg(F.count("*").alias("n")).where("n = 10").select("fam")
    return rows.join(full, "fam", "left_semi").select(F.concat(F.lit("K"), "fam").alias("famid"), "pid", "fatid", "motid", "sex", "nation")


# The same persons, families varied by number: those of a third fall into parts, in a third the youngest's parents are full sibs, and
# some have founders alone.
_KIND = "case when fam % 12 = 5 then 3 else fam % 3 end"
VARIED_PED_SQL = f"""select famid, pid, (case when kind = 3 or (kind = 1 and pid >= 7) then -1 when kind = 2 and pid = 9 then 7 else fatid end)::int as fatid,
    (case when kind = 3 or (kind = 1 and pid >= 7) then -1 when kind = 2 and pid = 9 then 8 else motid end)::int as motid, sex, nation
    from (select *, {_KIND} as kind from (select *, substr(famid, 2)::int as fam from ({BIG_PED_SQL})))"""
WITH_VARIED = f"with kp as ({VARIED_PED_SQL})"


def varied_pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = big_pedigree(spark, sf_dir).withColumn("fam", F.expr("cast(substr(famid, 2) as int)")).withColumn("kind", F.expr(_KIND))
    alone = (F.col("kind") == 3) | ((F.col("kind") == 1) & (F.col("pid") >= 7))
    parent = lambda c, sib: F.when(alone, -1).when((F.col("kind") == 2) & (F.col("pid") == 9), sib).otherwise(F.col(c)).cast("int").alias(c)
    return p.select("famid", "pid", parent("fatid", 7), parent("motid", 8), "sex", "nation")


@query(WITH_VARIED + f""", every as (select famid, pid, fatid, motid from kp union all select famid, pid, fatid, motid from ({X.pedigree_sql()})),
    g as (select c.famid, count(*)::int as n, (count(*) filter (c.fatid < 0))::int as n_founders, coalesce(bool_or(c.fatid >= 0 and (f.fatid >= 0 or m.fatid >= 0)), false) as far
        from every c left join every f on f.famid = c.famid and f.pid = c.fatid left join every m on m.famid = c.famid and m.pid = c.motid group by c.famid)
    select famid, n, n_founders, case when n = n_founders then 1 when far then 3 else 2 end as generations, n > n_founders and not far and n_founders = 2 as is_nuclear from g""")
def family_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.family_table(varied_pedigree(spark, sf_dir).drop("nation").unionByName(X.pedigree(spark)))


@query(WITH_PED + ", b as (select famid, pid, case when pid = 5 and nation = 3 then -1 else fatid end as fatid, case when pid = 8 and nation < 4 then 4 else motid end as motid, "
    "case when pid = 0 and nation = 7 then 2 else sex end as sex from kp), j as (select b.*, f.sex as fs, m.sex as ms from b left join b f on f.famid = b.famid and f.pid = b.fatid "
    "left join b m on m.famid = b.famid and m.pid = b.motid) select famid, pid, case when (fatid < 0) <> (motid < 0) then 'one_parent' when fs = 2 and ms = 1 then 'swapped_parents' "
    "else 'parent_sex' end as problem from j where (fatid < 0) <> (motid < 0) or fs = 2 or ms = 1")
def check_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = big_pedigree(spark, sf_dir)
    return P.check_parents(p.select("famid", "pid", F.when((F.col("pid") == 5) & (F.col("nation") == 3), -1).otherwise(F.col("fatid")).alias("fatid"), F.when((F.col("pid") == 8) & (F.col("nation") < 4), 4).otherwise(F.col("motid")).alias("motid"), F.when((F.col("pid") == 0) & (F.col("nation") == 7), 2).otherwise(F.col("sex")).alias("sex")))


@query(WITH_PED + """, b as (select famid, pid, case when nation % 2 = 0 then motid else fatid end as fatid, case when nation % 2 = 0 then fatid else motid end as motid, sex from kp),
    j as (select b.*, coalesce(f.sex = 2 and m.sex = 1, false) as swap from b left join b f on f.famid = b.famid and f.pid = b.fatid left join b m on m.famid = b.famid and m.pid = b.motid)
    select famid, pid, nullif(case when swap then motid else fatid end, -1) as fatid, nullif(case when swap then fatid else motid end, -1) as motid, sex from j""")
def fix_swapped_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = big_pedigree(spark, sf_dir)
    swap = F.col("nation") % 2 == 0
    return P.fix_swapped(p.select("famid", "pid", F.when(swap, F.col("motid")).otherwise(F.col("fatid")).alias("fatid"), F.when(swap, F.col("fatid")).otherwise(F.col("motid")).alias("motid"), "sex"))


@query(WITH_PED + " select famid, fatid, motid, string_agg(pid::varchar, ',' order by pid) as sibs from kp where fatid >= 0 group by all")
def sibships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sibships(big_pedigree(spark, sf_dir)).select("famid", "fatid", "motid", F.array_join(F.col("sibs").cast("array<string>"), ",").alias("sibs"))


@query(WITH_PED + " select famid, pid, (row_number() over (partition by famid order by fatid >= 0, pid))::int as ord from kp")
def pedigree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ordered(big_pedigree(spark, sf_dir))


@query(WITH_PED.replace("with", "with recursive", 1) + ", anc as (select famid, pid, unnest([fatid, motid]) as ancestor from kp where fatid >= 0 union select a.famid, a.pid, "
    "unnest([k.fatid, k.motid]) from anc a join kp k on k.famid = a.famid and k.pid = a.ancestor where k.fatid >= 0) select distinct famid, pid, ancestor from anc")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ancestors(big_pedigree(spark, sf_dir))


def _kinship_sql(x_linked: bool) -> str:
    """Pairs go back to the parents of the younger one, with half the weight each; a pair of one person adds its own share.
    X-linked, a son has his mother alone."""
    male = "m.sex = 1" if x_linked else "false"
    step = f"""select k.famid, p1, p2, greatest(f.x, k.b) as a, least(f.x, k.b) as b, case when {male} then (case when f.k = 2 then w else 0 end) else w / 2 end as w
  from k join kp m on m.famid = k.famid and m.pid = k.a, unnest([1, 2]) u(i), lateral (select case when i = 1 then m.fatid else m.motid end as x, i as k) f where m.fatid >= 0 and k.a <> k.b and k.w > 0
  union all select k.famid, p1, p2, greatest(m.fatid, m.motid), least(m.fatid, m.motid), case when {male} then 0 else w / 2 end from k join kp m on m.famid = k.famid and m.pid = k.a where m.fatid >= 0 and k.a = k.b and k.w > 0"""
    women = "and sex <> 1" if x_linked else ""
    return WITH_VARIED.replace("with", "with recursive", 1) + f""", k(famid, p1, p2, a, b, w) as (select x.famid, x.pid, y.pid, y.pid, x.pid, 1.0::double from kp x join kp y on x.famid = y.famid and x.pid <= y.pid
  union all select * from ({step})),
 kin as (select k.famid, p1 as pid1, p2 as pid2, coalesce(sum(case when a = b then w * (case when {male} then 1 else 0.5 end) end), 0)::double as phi from k join kp m on m.famid = k.famid and m.pid = k.a group by all),
 inbred as (select distinct kp.famid from kp join kin on kin.famid = kp.famid and pid1 = least(fatid, motid) and pid2 = greatest(fatid, motid) where phi > 0 {women})
 select famid, pid1, pid2, phi, famid in (select famid from inbred) as inbred from kin"""


@query(_kinship_sql(False))
def kinship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.kinship(varied_pedigree(spark, sf_dir))


@query(_kinship_sql(True))
def kinship_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.kinship(varied_pedigree(spark, sf_dir), x_linked=True)


@query(WITH_VARIED.replace("with", "with recursive", 1) + """, e as (select famid, pid as a, unnest([fatid, motid]) as b from kp where fatid >= 0), ways as (select * from e union all select famid, b, a from e),
    r as (select famid, pid, pid as o from kp union select r.famid, r.pid, ways.b from r join ways on ways.famid = r.famid and ways.a = r.o) select famid, pid, min(o)::int as grp from r group by famid, pid""")
def connected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.connected_groups(varied_pedigree(spark, sf_dir))


def _trim_sql() -> str:
    """The rule worked out for this pedigree: leaves without data go, then those whose children have gone, then couples of
    founders without data of one child, the older generation first."""
    d = ", ".join(f"max((pid = {i} and nation < 4)::int) = 1 as d{i}" for i in range(10))
    keep = {0: "k0 and not cut01", 1: "k1 and not cut01", 2: "k2 and not cut23", 3: "k3 and not cut23", 4: "k4 and not cut46", 5: "d5", 6: "k6 and not cut46", 7: "d7", 8: "d8", 9: "d9"}
    founder = {4: "cut01", 5: "cut01", 6: "cut23", 7: "cut46", 8: "cut46", 9: "cut46"}
    cases = lambda m, other: "case " + " ".join(f"when pid = {i} then {c}" for i, c in m.items()) + f" else {other} end"
    return WITH_PED + f""", f as (select famid, {d} from kp group by famid),
 g as (select *, d7::int + d8::int + d9::int as n from f), h as (select *, n > 0 or d4 as k4, n > 0 or d6 as k6 from g),
 i as (select *, k6 or d2 as k2, k6 or d3 as k3, k4 or d5 or d0 as k0, k4 or d5 or d1 as k1, k6 and not d2 and not d3 as cut23, k4 <> d5 and not d0 and not d1 as cut01 from h),
 j as (select *, cut01 and cut23 and k4 and not d4 and not d6 and n = 1 as cut46 from i)
 select famid, pid, case when not {cases(founder, 'true')} then fatid end as fatid, case when not {cases(founder, 'true')} then motid end as motid, sex from kp join j using (famid) where {cases(keep, 'false')}"""


@query(_trim_sql())
def trim_pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = big_pedigree(spark, sf_dir)
    return P.trim(p, p.where("nation < 4"))


@query(WITH_PED + " select famid, string_agg(pid::varchar, '$' order by pid) as twins, count(distinct sex) = 1 as same_sex from kp where pid in (7, 8, 9) and nation < 15 group by famid having count(*) > 1")
def twin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = big_pedigree(spark, sf_dir).withColumn("zygosity", F.when(F.col("pid").isin(7, 8, 9) & (F.col("nation") < 15), 1).otherwise(0))
    return P.twin_groups(z).select("famid", F.array_join(F.col("twins").cast("array<string>"), "$").alias("twins"), "same_sex")


@query(WITH_PED + " select famid, case when pid in (7, 9) then '7$9' else pid::varchar end as pid, fatid::varchar as fatid, motid::varchar as motid, sex, max(1 + nation % 2)::int as affected from kp group by all")
def merge_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = big_pedigree(spark, sf_dir).withColumn("zygosity", F.when(F.col("pid").isin(7, 9), 1).otherwise(0)).withColumn("affected", 1 + F.col("nation") % 2)
    return P.merge_twins(z)


@query(WITH_PED + ", k as (select a.famid, a.pid as pid1, b.pid as pid2, case when a.pid = b.pid then 3 when a.fatid < 0 and b.fatid < 0 then 1 when b.fatid = a.pid or b.motid "
    "= a.pid or a.fatid = b.pid or a.motid = b.pid then 2 end as r from kp a join kp b on a.famid = b.famid and a.pid <= b.pid) select famid, pid1, pid2, case when r is not null "
    "then (r = 1)::int::double end as p0, case when r is not null then (r = 2)::int::double end as p1, case when r is not null then (r = 3)::int::double end as p2 from k")
def ibd_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ibd_prior(big_pedigree(spark, sf_dir))


_COUNTS_SQL = ("cnt as (select marker, u.allele, count(*) as n, count(*) filter (fatid < 0) as nf from (select marker, ped.fatid, case when chrom = 'X' and sex = 1 then [a1] "
    "else [a1, a2] end as al from geno join ped using (famid, pid)), unnest(al) u(allele) group by marker, u.allele)")


@query(X.WITH_GENO + f", {_COUNTS_SQL}, f as (select marker, allele, case when sum(nf) over (partition by marker) = 0 then n when nf > 0 then nf else 1 end as n from cnt) "
    f"select marker, allele, round(n / sum(n) over (partition by marker), 9) as freq from f")
def allele_frequencies_founders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.allele_frequencies(X.genotypes(spark, sf_dir), X.pedigree(spark)).select("marker", "allele", F.round("freq", 9).alias("freq"))


@query(X.WITH_GENO + f", {_COUNTS_SQL} select marker, allele, round(n / sum(n) over (partition by marker), 9) as freq from cnt")
def allele_frequencies_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.allele_frequencies(X.genotypes(spark, sf_dir), X.pedigree(spark), "all").select("marker", "allele", F.round("freq", 9).alias("freq"))


@query(X.WITH_GENO + f", {_COUNTS_SQL}, r as (select *, n <= floor(sum(n) over (partition by marker) * 0.2) as rare from cnt) select marker, allele, (case when rare then count(*) "
    f"filter (not rare) over (partition by marker) + 1 else row_number() over (partition by marker order by rare, n desc, allele) end)::int as code, case when rare then 'OTHER' "
    f"else allele::varchar end as label from r")
def lump_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lump_alleles(M.allele_counts(X.genotypes(spark, sf_dir), X.pedigree(spark)), 0.2)


_TRIO_SQL = ("tr as (select c.marker, c.famid, c.pid, c.a1, c.a2, p.sex, f.a1 as f1, f.a2 as f2, m.a1 as m1, m.a2 as m2 from geno c join ped p using (famid, pid) left join "
    "geno f on f.marker = c.marker and f.famid = c.famid and f.pid = p.fatid left join geno m on m.marker = c.marker and m.famid = c.famid and m.pid = p.motid where p.fatid >= "
    "0), ok as (select *, (f1 is null or a1 in (f1, f2)) and (m1 is null or a2 in (m1, m2)) as one, (f1 is null or a2 in (f1, f2)) and (m1 is null or a1 in (m1, m2)) as two from "
    "tr)")


@query(X.WITH_GENO + f", {_TRIO_SQL} select marker, famid, pid from ok where not one and not two")
def mendel_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mendel_errors(X.genotypes(spark, sf_dir), X.pedigree(spark))


_HET = "(sex = 1 and a1 <> a2)"
_TRIO_X_SQL = f"gx as (select g.* from geno g join ped using (famid, pid) where not {_HET}), " + _TRIO_SQL.replace("geno ", "gx ")


@query(X.WITH_GENO + f""", {_TRIO_X_SQL} select g.marker, g.famid, g.pid, 'het_male' as problem from geno g join ped using (famid, pid) where {_HET}
    union all select marker, famid, pid, 'son' from tr where sex = 1 and m1 is not null and a1 not in (m1, m2)
    union all select marker, famid, pid, 'daughter' from tr where sex = 2
        and not ((f1 is null or a1 = f1) and (m1 is null or a2 in (m1, m2))) and not ((f1 is null or a2 = f1) and (m1 is null or a1 in (m1, m2)))""")
def mendel_errors_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mendel_errors_x(X.genotypes(spark, sf_dir), X.pedigree(spark))


# For sibships of three: every part is a marker at which one family of the big pedigree is typed, dealt by the part's number.
_BIG_GENO = ("select marker, famid, pid, (1 + (marker * 7 + pid * 3 + nation) % 4)::int as a1, (1 + (marker * 5 + pid * pid + nation * 3) % 4)::int as a2 from kp join (select "
    "p_partkey as marker, 'K' || (p_partkey % (select count(distinct famid) from kp)) as famid from part) using (famid) where (marker + pid + nation) % 9 > 0")
WITH_BIG = WITH_PED + f", bg as ({_BIG_GENO})"


def big_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = big_pedigree(spark, sf_dir)
    n = p.agg(F.countDistinct("famid").alias("n"))
    m = X.table(spark, sf_dir, "part").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("marker"), F.concat(F.lit("K"), F.col("p_partkey") % F.col("n")).alias("famid"))
    return p.join(m, "famid").where("(marker + pid + nation) % 9 > 0").selectExpr("marker", "famid", "pid", "cast(1 + (marker * 7 + pid * 3 + nation) % 4 as int) as a1", "cast(1 "
        "+ (marker * 5 + pid * pid + nation * 3) % 4 as int) as a2")


@query(WITH_BIG + ", c as (select distinct marker, bg.famid, fatid, motid, least(a1, a2) as lo, greatest(a1, a2) as hi from bg join kp using (famid, pid) where fatid >= 0), "
    "n as (select marker, famid, fatid, motid, count(*) as kinds, count(*) filter (lo = hi) as hom from c group by all), a as (select marker, famid, fatid, motid, allele, count(*) "
    "as k from (select *, unnest(list_distinct([lo, hi])) as allele from c) group by all), m as (select marker, famid, fatid, motid, count(*) as alleles, max(k) as most from a "
    "group by all) select marker, famid, fatid, motid from n join m using (marker, famid, fatid, motid) where kinds > 4 or alleles + hom > 4 or (alleles = 4 and most > 2)")
def sibship_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sibship_errors(big_genotypes(spark, sf_dir), big_pedigree(spark, sf_dir))


@query(WITH_BIG + ", c as (select marker, bg.famid, bg.pid, fatid, motid, a1, a2 from bg join kp using (famid, pid) where fatid >= 0) select x.marker, x.famid, x.pid as pid1, "
    "y.pid as pid2, case when (x.a1 = y.a1 and x.a2 = y.a2) or (x.a1 = y.a2 and x.a2 = y.a1) then 2 when x.a1 in (y.a1, y.a2) or x.a2 in (y.a1, y.a2) then 1 else 0 end as ibs from "
    "c x join c y on x.marker = y.marker and x.famid = y.famid and x.fatid = y.fatid and x.motid = y.motid and x.pid < y.pid")
def sib_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sib_sharing(big_genotypes(spark, sf_dir), big_pedigree(spark, sf_dir))


def _ibd_sql() -> str:
    fits = lambda s, i, k: f"(({s}.a1 = f.a{i} and {s}.a2 = m.a{k}) or ({s}.a2 = f.a{i} and {s}.a1 = m.a{k}))"
    ways: dict[int, list[str]] = {0: [], 1: [], 2: []}
    for i in (1, 2):
        for k in (1, 2):
            for i2 in (1, 2):
                for k2 in (1, 2):
                    ways[(i == i2) + (k == k2)].append(f"coalesce(({fits('x', i, k)} and {fits('y', i2, k2)})::int, 0)")
    n = [" + ".join(ways[z]) for z in range(3)]
    g = lambda a, who: f"left join geno {a} on {a}.marker = s.marker and {a}.famid = s.famid and {a}.pid = s.{who}"
    return (X.WITH_GENO + f", s as (select mk.marker, p.famid, p.pid as pid1, q.pid as pid2, p.fatid, p.motid from ped p join ped q on p.famid = q.famid and p.fatid = q.fatid "
        f"and p.motid = q.motid and p.pid < q.pid and p.fatid >= 0 join (select distinct marker, famid from geno) mk on mk.famid = p.famid), w as (select s.*, {n[0]} as n0, {n[1]} as "
        f"n1, {n[2]} as n2 from s {g('x', 'pid1')} {g('y', 'pid2')} {g('f', 'fatid')} {g('m', 'motid')}) select marker, famid, pid1, pid2, round(case when n0 + n1 + n2 > 0 then n0 / "
        f"(n0 + n1 + n2) else 0.25 end, 9) as p0, round(case when n0 + n1 + n2 > 0 then n1 / (n0 + n1 + n2) else 0.5 end, 9) as p1, round(case when n0 + n1 + n2 > 0 then n2 / (n0 + "
        f"n1 + n2) else 0.25 end, 9) as p2 from w")


@query(_ibd_sql())
def sib_ibd(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.sib_ibd(X.genotypes(spark, sf_dir), X.pedigree(spark))
    return got.select("marker", "famid", "pid1", "pid2", *[F.round(f"p{i}", 9).alias(f"p{i}") for i in range(3)])


@query(X.WITH_GENO + f", {_TRIO_SQL} select marker, famid, pid, case when a1 = a2 and one then a1 when one and not two then a1 when two and not one then a2 end as paternal, "
    f"case when a1 = a2 and one then a1 when one and not two then a2 when two and not one then a1 end as maternal from ok")
def phase_trios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.phase_trios(X.genotypes(spark, sf_dir), X.pedigree(spark))


# X-linked genotypes of the big pedigree: mostly equal alleles of males, and two alleles only at every second marker.
_BIG_X = """bx as (select marker, famid, pid, (1 + (a1 - 1) % k)::int as a1, (1 + (case when sex = 1 and (marker + pid) % 11 > 0 then a1 else a2 end - 1) % k)::int as a2
    from (select bg.*, sex, case when marker % 2 = 0 then 2 else 4 end as k from bg join kp using (famid, pid)))"""


def big_x_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = big_genotypes(spark, sf_dir).join(big_pedigree(spark, sf_dir).select("famid", "pid", "sex"), ["famid", "pid"])
    k = "case when marker % 2 = 0 then 2 else 4 end"
    return g.selectExpr("marker", "famid", "pid", f"cast(1 + (a1 - 1) % {k} as int) as a1", f"cast(1 + (case when sex = 1 and (marker + pid) % 11 > 0 then a1 else a2 end - 1) % {k} as int) as a2")


@query(WITH_BIG + f""", {_BIG_X}, geno as (select bx.* from bx join kp using (famid, pid) where not {_HET}),
    tr as (select c.marker, c.famid, c.pid, p.sex, p.fatid, p.motid, c.a1, c.a2, f.a1 as f1, m.a1 as m1, m.a2 as m2 from geno c join kp p using (famid, pid)
        left join geno f on f.marker = c.marker and f.famid = c.famid and f.pid = p.fatid left join geno m on m.marker = c.marker and m.famid = c.famid and m.pid = p.motid where p.fatid >= 0),
    fine as (select * from tr where case sex when 1 then m1 is null or a1 in (m1, m2)
        else ((f1 is null or a1 = f1) and (m1 is null or a2 in (m1, m2))) or ((f1 is null or a2 = f1) and (m1 is null or a1 in (m1, m2))) end),
    al as (select unnest([1, 2, 3, 4]) as allele), mothers as (select a.allele as p, b.allele as q from al a, al b where a.allele <= b.allele),
    ways as (select marker, famid, fatid, motid, x.allele as x, p, q, bool_and(case sex when 1 then a1 in (p, q) else (a1 = x.allele and a2 in (p, q)) or (a2 = x.allele and a1 in (p, q)) end) as ok
        from fine, al x, mothers where (f1 is null or f1 = x.allele) and (m1 is null or (least(m1, m2) = p and greatest(m1, m2) = q)) group by all)
    select marker, famid, fatid, motid from ways group by all having not bool_or(ok)""")
def mendel_errors_x_sibships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mendel_errors_x_sibships(big_x_genotypes(spark, sf_dir), big_pedigree(spark, sf_dir))


def _elimination_sql(x_linked: bool) -> str:
    """The families of the twelve are nuclear: all genotypes of a couple with what each child can have of them."""
    male, fits = "true", "(least(fx, mx), greatest(fx, mx)) = (x, y) or (least(fx, my), greatest(fx, my)) = (x, y) or (least(fy, mx), greatest(fy, mx)) = (x, y) or (least(fy, my), greatest(fy, my)) = (x, y)"
    if x_linked:
        male, fits = "(sex <> 1 or x = y)", f"case sex when 1 then x = y and x in (mx, my) else {fits} end"
    return X.WITH_GENO + f""", k as (select distinct marker, famid from geno), al as (select distinct * from (select marker, famid, unnest([a1, a2, 0]) as allele from geno)),
    own as (select k.marker, famid, pid, sex, fatid, a.allele as x, b.allele as y from k join ped using (famid) join al a using (marker, famid) join al b using (marker, famid) left join geno g using (marker, famid, pid)
        where a.allele <= b.allele and (g.a1 is null or (least(a1, a2) = a.allele and greatest(a1, a2) = b.allele)) and {male.replace("x = y", "a.allele = b.allele")}),
    couple as (select f.marker, f.famid, f.x as fx, f.y as fy, m.x as mx, m.y as my from own f join own m using (marker, famid) where f.pid in (0, 4) and m.pid in (1, 5)),
    child as (select c.*, o.pid, x, y from couple c join own o using (marker, famid) where fatid >= 0 and ({fits})),
    fine as (select marker, famid, fx, fy, mx, my from child group by all having count(distinct pid) = 2),
    left_ as (select marker, famid, case famid when 'F1' then 0 else 4 end as pid, fx as x, fy as y from fine union select marker, famid, case famid when 'F1' then 1 else 5 end, mx, my from fine
        union select marker, famid, pid, x, y from child join fine using (marker, famid, fx, fy, mx, my) union select marker, famid, pid, x, y from own where pid >= 8)
    select k.marker, famid, pid, coalesce(string_agg(x || '/' || y, ',' order by x, y), '') as possible from k join ped using (famid) left join left_ l using (marker, famid, pid) group by all"""


@query(_elimination_sql(False))
def eliminate_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.eliminate_genotypes(X.genotypes(spark, sf_dir), X.pedigree(spark))


@query(_elimination_sql(True))
def eliminate_genotypes_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.eliminate_genotypes(X.genotypes(spark, sf_dir), X.pedigree(spark), x_linked=True)


@query()
def eliminate_genotypes_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of three generations, X-linked."""
    return M.eliminate_genotypes(big_x_genotypes(spark, sf_dir), big_pedigree(spark, sf_dir), x_linked=True)


@query(f"with t as ({X.TRAITS_SQL}), v as (select trait, value, count(*) as k from t where value is not null group by all) select trait, value, k, round(coalesce(sum(k) over "
    f"(partition by trait order by value rows between unbounded preceding and 1 preceding), 0) + (k - 1) / 2, 6) as rank, (sum(k) over (partition by trait))::bigint as n from v")
def mid_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mid_ranks(X.traits(spark, sf_dir)).withColumn("rank", F.round("rank", 6))


@query()
def inverse_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.inverse_normal(X.traits(spark, sf_dir))


@query(f"with t as ({X.TRAITS_SQL}), m as (select trait, avg(value) as mean from t where pid % 3 <> 0 and value is not null group by trait) select famid, pid, trait, value, "
    f"case when pid % 3 = 0 or value is null then 0 when value > mean then 2 else 1 end as status from t left join m using (trait)")
def dichotomize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.traits(spark, sf_dir)
    return M.dichotomize(t, t.where("pid % 3 = 0").select("famid", "pid"))


@query("with o as (select p_size % 5 as x, p_brand as y, count(*) as o from part group by all), n as (select sum(o) as n from o), r as (select x, sum(o) as r from o group "
    "by x), c as (select y, sum(o) as c from o group by y), e as (select coalesce(o.o, 0) as o, r * c / n as e from r cross join c cross join n left join o on o.x = r.x and o.y "
    "= c.y), s as (select sum((o - e) * (o - e) / e) as chi2 from e) select round(chi2, 6) as chi2, (select ((count(distinct x) - 1) * (count(distinct y) - 1)) from o) as df, round(sqrt(chi2 "
    "/ ((select n from n) * (select least(count(distinct x), count(distinct y)) - 1 from o))), 6) as cramer_v, round(sqrt(chi2 / (chi2 + (select n from n))), 6) as contingency_c "
    "from s")
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("x"), F.col("p_brand").alias("y"))
    return M.chi_square(p, "x", "y").select(F.round("chi2", 6).alias("chi2"), "df", F.round("cramer_v", 6).alias("cramer_v"), F.round("contingency_c", 6).alias("contingency_c"))


@query("with o as (select p_size % 5 as x, p_brand as y, count(*) as o from part group by all), n as (select sum(o)::double as n from o), h as (select sum(-o / n * ln(o / "
    "n)) as h from o, n), hx as (select sum(-r / n * ln(r / n)) as hx from (select sum(o) as r from o group by x), n), hy as (select sum(-r / n * ln(r / n)) as hy from (select "
    "sum(o) as r from o group by y), n) select round(h, 6) as h, round(hx, 6) as hx, round(hy, 6) as hy, round(h - hx, 6) as hy_x, round(h - hy, 6) as hx_y, round(2 * (hx + hy "
    "- h) / (hx + hy), 6) as uxy from h, hx, hy")
def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("x"), F.col("p_brand").alias("y"))
    return M.entropies(p, "x", "y").select(*[F.round(c, 6).alias(c) for c in ("h", "hx", "hy", "hy_x", "hx_y", "uxy")])


@query("""with d as (select p_size as x, p_partkey * 7 % 41 as y from part), r as (select x, y, (rank() over (order by x) + count(*) over (partition by x) * 0.5 - 0.5)::double as rx,
        (rank() over (order by y) + count(*) over (partition by y) * 0.5 - 0.5)::double as ry from d),
    tx as (select sum(k * k * k - k)::double as tx from (select count(*) as k from d group by x)), ty as (select sum(k * k * k - k)::double as ty from (select count(*) as k from d group by y)),
    s as (select count(*) as n, sum((rx - ry) * (rx - ry)) as d2, corr(rx, ry) as r, count(*)::double as m, m * m * m - m as en from r)
    select n, round(d2, 3) as d2, round(r, 6) as r, round(r * sqrt(n - 1), 6) as z, round((d2 - (en / 6 - (tx + ty) / 12)) / sqrt((m - 1) * m * m * (m + 1) * (m + 1) / 36 * (1 - tx / en) * (1 - ty / en)), 6) as z_d from s, tx, ty""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.table(spark, sf_dir, "part").selectExpr("p_size as x", "p_partkey * 7 % 41 as y")
    return M.spearman(p, "x", "y").select("n", F.round("d2", 3).alias("d2"), F.round("r", 6).alias("r"), F.round("z", 6).alias("z"), F.round("z_d", 6).alias("z_d"))


@query(f"with sites as ({X.SITES_SQL}), o as (select chrom, site as marker, (row_number() over (partition by chrom order by pos, site))::int as ord from sites), c as (select "
    f"chrom, lead(chrom) over (order by chrom) as next_chrom from (select distinct chrom from sites)) select o.chrom, marker, ord, next_chrom from o join c using (chrom)")
def ordered_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ordered_markers(X.sites(spark, sf_dir).select("chrom", F.col("site").alias("marker"), "pos"))


@query("with c as (select p_partkey, array_to_string([substr('ACGU', (1 + p_partkey % 4)::int, 1), substr('acgt', (1 + p_partkey // 4 % 4)::int, 1), substr('ACGT', (1 + p_partkey "
    "// 16 % 4)::int, 1)], '') as codon from part), u as (select *, replace(upper(codon), 'U', 'T') as k from c) select p_partkey, codon, substr('" + codons.CODE + "', (instr('TCAG', "
    "k[1]) - 1) * 16 + (instr('TCAG', k[2]) - 1) * 4 + instr('TCAG', k[3]), 1) as letter from u")
def codon_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(substring('ACGU', cast(1 + p_partkey % 4 as int), 1), substring('acgt', cast(1 + p_partkey div 4 % 4 "
        "as int), 1), substring('ACGT', cast(1 + p_partkey div 16 % 4 as int), 1)) as codon")
    return p.select("p_partkey", "codon", codons.amino_acid(F.col("codon")).alias("letter"))


_BED = f"list_transform({_DOS}, lambda d: case d when 0 then 0 when 1 then 2 when 2 then 3 else 1 end)"


@query(X.WITH_VCF + f", k as (select *, {_BED} as c from vcf where length(ref) = 1 and length(alt) = 1) select case chrom when 'X' then 23 when 'Y' then 24 when 'MT' then "
    f"25 else chrom::int end as chrom, case when id = '.' then chrom || ':' || pos else id end as name, 0 as cm, pos, ref, alt, array_to_string(list_transform(range(3), lambda b: "
    f"lpad(printf('%X', (c[b * 4 + 1] + c[b * 4 + 2] * 4 + c[b * 4 + 3] * 16 + c[b * 4 + 4] * 64)::int), 2, '0')), '') as bed from k")
def plink_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.plink_markers(X.vcf_rows(spark, sf_dir))


@query(X.WITH_VCF + f""" select case when id = '.' then chrom || ':' || pos else id end as marker, 's' || k as iid, k::int as person, d::int as dosage
    from (select chrom, pos, id, unnest(range(12)) as k, unnest({_DOS}) as d from vcf where length(ref) = 1 and length(alt) = 1)""")
def plink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as .bed, .bim and .fam and read back."""
    prefix = f"{new_folder(spark)}.plink"
    B.write_plink(X.vcf_rows(spark, sf_dir), [f"s{i}" for i in range(X.SAMPLES)], prefix)
    return B.read_plink(spark, prefix).select("marker", "iid", "person", "dosage")


@query(X.WITH_VCF + f" select chrom, pos, k::int as sample, d::int as dosage from (select chrom, pos, unnest(range(12)) as k, unnest({_DOS}) as d from vcf)")
def dosage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dosages(X.vcf_rows(spark, sf_dir))


@query(f"with k as (select c_custkey as pid, 'F' || (c_custkey % 7) as famid, c_custkey % 5 as glf from customer), ix as (select '2' as key, 'a.bin' as file union all select "
    f"'3', 'b.bin') select famid, pid, file from k left join ix on key = nullif(glf, 0)::varchar")
def bind_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ped = X.table(spark, sf_dir, "customer").selectExpr("concat('F', c_custkey % 7) as famid", "c_custkey as pid", "cast(c_custkey % 5 as double) as glf")
    index = spark.createDataFrame([("2", "a.bin"), ("3", "b.bin")], "key string, file string")
    return T.bind_files(ped, index, "glf")


@query()
def call_vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.genome_sorted(T.call_lines(calling.call_variants(X.gl_obs(spark, sf_dir), list(X.PEDIGREE12)), list(X.PEDIGREE12))).select("value")


_WIDE_F = 0.7


def _wide_sql(points: list[float]) -> str:
    """chrom, pos, f, l: nuclear families of two children and persons alone, autosomes, the alleles ref and its transition, at each point."""
    ts = _TS.format("ref_base")
    lk = ", ".join(f"pow(10.0::double, -pl[{_IDX.format(a, b)} + 1] / 10.0::double)" for a, b in (("ref_base", "ref_base"), ("ref_base", ts), (ts, ts)))
    pass_alt = lambda g: f"(({g} - 1) / 2.0::double)"
    given = f"(k[1] * (1 - {pass_alt('gf')}) * (1 - {pass_alt('gm')}) + k[2] * ({pass_alt('gf')} * (1 - {pass_alt('gm')}) + {pass_alt('gm')} * (1 - {pass_alt('gf')})) + k[3] * {pass_alt('gf')} * {pass_alt('gm')})"
    grid = ", ".join(f"{p}::double" for p in points)
    return X.WITH_OBS + f""", s as (select distinct chrom, pos from obs where chrom not in ('X', 'Y', 'MT')), g3 as (select unnest([1, 2, 3]) as g),
    pts as (select f, [f * f, 2 * f * (1 - f), (1 - f) * (1 - f)] as pr from (select unnest([{grid}]) as f)),
    lk as (select chrom, pos, pid, famid, fatid, coalesce(k, [1.0::double, 1.0, 1.0]) as k from s cross join ped left join (select chrom, pos, sample_id as pid, [{lk}] as k from obs) using (chrom, pos, pid)),
    fm as (select f.chrom, f.pos, f.famid, gf.g as gf, gm.g as gm, f.k[gf.g] * m.k[gm.g] as w from lk f join lk m using (chrom, pos, famid), g3 gf, g3 gm where f.pid in (0, 4) and m.pid in (1, 5)),
    ch as (select chrom, pos, famid, gf, gm, product({given}) as w from (select lk.*, gf.g as gf, gm.g as gm from lk, g3 gf, g3 gm where fatid >= 0) group by all),
    fam as (select chrom, pos, famid, f, sum(pr[gf] * pr[gm] * fm.w * ch.w) as l from fm join ch using (chrom, pos, famid, gf, gm), pts group by all
        union all select chrom, pos, famid, f, sum(pr[g] * k[g]) from lk, g3, pts where pid >= 8 group by all),
    wide as (select chrom, pos, f, sum(log10(l)) as l from fam group by all)"""


@query(_wide_sql(GRID) + ", r as (select chrom, pos, f, round(l, 9) as l from wide) select chrom, pos, arg_max(f, (l, -f)) as ref_freq, round(max(l), 6) as llk from r group by chrom, pos")
def wide_cohort_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calling.wide_cohort_frequencies(X.gl_obs(spark, sf_dir).where("chrom not in ('X', 'Y', 'MT')"), list(X.PEDIGREE12), GRID)


@query(_wide_sql([_WIDE_F]) + " select chrom, pos, round(l, 6) as llk from wide")
def wide_cohort_llk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of the wide cohort's search, at a fixed frequency."""
    obs = X.gl_obs(spark, sf_dir).where("chrom not in ('X', 'Y', 'MT')")
    return wide.wide_llk(obs, X.pedigree(spark), (_WIDE_F,)).select("chrom", "pos", F.round("l0", 6).alias("llk"))


@query()
def call_wide_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.call_wide_cohort(X.gl_obs(spark, sf_dir), X.pedigree(spark))[0]


_UNRELATED_F = 0.8


def _unrelated_sql() -> str:
    ts = _TS.format("ref_base")
    pair = "(x = ref_base and y = ref_base)", f"(x = least(ref_base, {ts}) and y = greatest(ref_base, {ts}))", f"(x = {ts} and y = {ts})"
    prior = f"case when {pair[0]} then {_UNRELATED_F**2} when {pair[1]} then {2 * _UNRELATED_F * (1 - _UNRELATED_F)} when {pair[2]} then {(1 - _UNRELATED_F) ** 2} else 0.0 end"
    return X.WITH_OBS + f""", s as (select chrom, pos, min(ref_base) as ref_base from obs group by all), who as (select unnest(range(12)) as p), b as (select unnest([1, 2, 3, 4]) as n),
    w as (select s.chrom, s.pos, p, x, y, {prior}::double * pow(10.0::double, -coalesce(pl[{_IDX.format('x', 'y')} + 1], 0) / 10.0::double) as w
        from (select s.*, p, x.n as x, y.n as y from s, who, b x, b y where x.n <= y.n) s left join (select chrom, pos, sample_id as p, pl from obs) using (chrom, pos, p)),
    one as (select chrom, pos, p, round(max(w) / sum(w), 12) as q, min('ACGT'[x] || '/' || 'ACGT'[y]) filter (w = top) as gt from (select *, max(w) over (partition by chrom, pos, p) as top from w) group by all)
    select chrom, pos, p as sample_id, gt, case when q > 0.9999999999 then 100 else floor(-10 * log10(greatest(1 - q, 1e-11)) + 0.5)::int end as gq from one"""


@query(_unrelated_sql())
def call_unrelated_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes of unrelated persons at a fixed frequency, a row each."""
    got = calling.call_unrelated(X.gl_obs(spark, sf_dir), list(range(X.SAMPLES)), freq=_UNRELATED_F)
    one = F.transform(F.arrays_zip("gt", "gq"), lambda x, i: F.struct(i.alias("sample_id"), x["gt"].alias("gt"), x["gq"].alias("gq")))
    return got.select("chrom", "pos", F.explode(one).alias("x")).select("chrom", "pos", "x.*")


@query()
def call_unrelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calling.call_unrelated(X.gl_obs(spark, sf_dir), list(range(X.SAMPLES)))


@query()
def refine_vcf_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, o = [str(i) for i in range(X.SAMPLES)], calling.Options(compat=True)
    return T.refined_lines(calling.refine_vcf(X.vcf_rows(spark, sf_dir), names, list(X.PEDIGREE12), o), names, list(X.PEDIGREE12), o)


@query()
def denovo_vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.denovo_lines(calling.call_denovo(X.gl_obs(spark, sf_dir), list(X.PEDIGREE12), calling.Options(denovo=True, rate_denovo=1.5e-7)), list(X.PEDIGREE12))


@query(X.WITH_OBS + ", e as (select chrom, min(last) as e from (select chrom, sample_id, max(pos) as last from obs group by all) group by chrom), n as (select chrom, min(pos) "
    "as nxt from obs join e using (chrom) where pos > e group by chrom) select o.chrom, o.pos, sample_id from obs o join e using (chrom) left join n using (chrom) where o.pos <= "
    "coalesce(nxt, e)")
def until_first_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.until_first_end(X.gl_obs(spark, sf_dir)).select("chrom", "pos", "sample_id")


@query("select 'C' || c_custkey as name, case when c_custkey % 3 = 0 then 'both' else 'vcf_only' end as state from customer union all select 'C' || c_custkey || 'x', 'pedigree_only' from customer where c_custkey % 3 = 1")
def match_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "customer")
    ped = c.where("c_custkey % 3 < 2").selectExpr("case when c_custkey % 3 = 0 then concat('C', c_custkey) else concat('C', c_custkey, 'x') end as pid")
    return P.match_samples(c.selectExpr("concat('C', c_custkey) as name"), ped)


@query(f"with t as ({X.TRAITS_SQL}) select famid, pid, case when trait % 2 = 1 then value end as value from t where value is not null and famid = 'C7'")
def extract_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.traits(spark, sf_dir).withColumn("status", (F.col("trait") % 2).cast("int"))
    people = P.have_data(P.extract_family(t, "C7"), columns=["value"])
    return P.extract_on_affection(people, "status", 1, ["value"]).select("famid", "pid", "value")


@query(X.WITH_VCF + f", k as (select site as marker, {_BED} as c from vcf) select marker, array_to_string(list_transform(range(3), lambda b: lpad(printf('%X', (c[b * 4 + 1] "
    f"+ c[b * 4 + 2] * 4 + c[b * 4 + 3] * 16 + c[b * 4 + 4] * 64)::int), 2, '0')), '') as bed from k")
def pack_dosage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.dosages(X.vcf_rows(spark, sf_dir)).select(F.floor(F.col("pos") / 10).alias("marker"), F.col("sample").alias("person"), "dosage")
    return B.pack_matrix(d, X.SAMPLES)


@query("select l_orderkey, l_linenumber, l_partkey, (sum(l_quantity::bigint) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity rows unbounded preceding))::bigint as pos from lineitem")
def decode_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("sample_id"), F.lit("1").alias("chrom"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("rec_no"), F.col("l_quantity").cast("bigint").alias("offset"))
    return reads.decode_positions(steps).select("l_orderkey", "l_linenumber", "l_partkey", "pos")


_L = [f"-(p_partkey * {7 + 3 * i} % {41 + 2 * i}) / 4.0::double" for i in range(7)]


@query("with s as (select p_partkey, " + ", ".join(f"{x} as l{i}" for i, x in enumerate(_L)) + " from part), m as (select *, greatest(l0, l1, l2, l3, l4, l5, l6) as m from "
    "s), p as (select p_partkey, (list_position([l0, l1, l2, l3, l4, l5, l6], m) - 1)::int as config, 1 / (" + " + ".join(f"pow(10.0::double, l{i} - m)" for i in range(7)) + ") "
    "as posterior from m) select p_partkey, config, round(posterior, 9) as posterior, round(case when posterior > 0.9999999999 then 100 else -10 * log10(1 - posterior) end, 5) "
    "as qual from p")
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    s = X.table(spark, sf_dir, "part").select(key, *[(-(key * (7 + 3 * i) % (41 + 2 * i)) / 4.0).cast("double").alias(f"l{i}") for i in range(7)])
    return reads.best_config(s).select("p_partkey", "config", F.round("posterior", 9).alias("posterior"), F.round("qual", 5).alias("qual"))


@query("select p_partkey, substr(p_name, 1, 1) as label, instr('ACGT', upper(substr(p_name, 1, 1)))::int as code, case when p_partkey % 6 between 1 and 4 then substr('ACGT', "
    "(p_partkey % 6)::int, 1) else 'N' end as back from part")
def base_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.substring("p_name", 1, 1)
    return X.table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), S.base_code(label).alias("code"), S.base_label((F.col("p_partkey") % 6).cast("int")).alias("back"))


@query(WITH_BIG + ", g as (select marker, famid, least(a1, a2) as a1, greatest(a1, a2) as a2 from bg where pid in (7, 9)) select marker, famid, '7$9' as twins, count(distinct "
    "(a1, a2)) = 1 as agree, case when count(distinct (a1, a2)) = 1 then min(a1) end as a1, case when count(distinct (a1, a2)) = 1 then min(a2) end as a2 from g group by marker, "
    "famid")
def twin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = big_pedigree(spark, sf_dir).withColumn("zygosity", F.when(F.col("pid").isin(7, 9), 1).otherwise(0))
    return M.twin_check(big_genotypes(spark, sf_dir), P.twin_groups(z).select("famid", "twins"))


_TWO_LISTS = f"""rg as (select * from ({X.RANGES_SQL}) union all select chrom, pos as beg, pos + 2 as "end" from ({X.SITE_LIST_SQL}))"""


@query("with " + _TWO_LISTS + _MERGED[_MERGED.index(", w1 as") :] + " select * from merged")
def union_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.union_ranges(X.ranges(spark, sf_dir), X.site_list(spark, sf_dir).selectExpr("chrom", "pos as beg", "pos + 2 as end"))


@query("""select chrom, count(distinct contig_length) as lengths from (select 'c' || (l_partkey % 40) as chrom, 1000 + l_partkey % 40 + case when l_suppkey % 5 = 0 and l_partkey % 40 % 3 = 0 then 1 else 0 end as contig_length
    from lineitem) group by chrom having count(distinct contig_length) > 1""")
def incompatible_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "lineitem").selectExpr("concat('c', l_partkey % 40) as chrom", "1000 + l_partkey % 40 + case when l_suppkey % 5 = 0 and l_partkey % 40 % 3 = 0 then 1 else 0 end as contig_length")
    return B.incompatible_contigs(o)


@query("select p_size as marker, p_partkey as allele, round((p_partkey % 11 + 1) / sum(p_partkey % 11 + 1) over (partition by p_size), 9)::double as freq from part")
def scale_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.table(spark, sf_dir, "part").selectExpr("p_size as marker", "p_partkey as allele", "p_partkey % 11 + 1 as freq")
    return M.scale_frequencies(f).withColumn("freq", F.round("freq", 9))


@query(f"with t as ({X.TRAITS_SQL}) select famid, pid, case when value >= 0 then trait end as trait, case when value >= 0 then value end as value from t")
def blank_phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.traits(spark, sf_dir)
    return P.blank_phenotypes(t, ["trait", "value"], F.coalesce(F.col("value") < 0, F.lit(True)))


# A table of shared alleles for every third pair of the varied families, some listed twice with other values.
_LISTED = "select famid, a.pid as pid1, b.pid as pid2, 1 as marker, {0} as p0, {1} as p1, {2} as p2 from kp a join kp b using (famid) where a.pid <= b.pid and (a.pid + b.pid + a.nation) % 3 = 0"
_IBD_TABLE = _LISTED.format("0.25", "0.5", "0.25")


def _listed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = varied_pedigree(spark, sf_dir)
    a, b = p.select("famid", F.col("pid").alias("pid1"), "nation"), p.select("famid", F.col("pid").alias("pid2"))
    listed = a.join(b, "famid").where("pid1 <= pid2 and (pid1 + pid2 + nation) % 3 = 0")
    return listed.select("famid", "pid1", "pid2", F.lit(1).alias("marker"), F.lit(0.25).alias("p0"), F.lit(0.5).alias("p1"), F.lit(0.25).alias("p2"), "nation")


@query(WITH_VARIED + f""", t as ({_IBD_TABLE}), w as (select a.famid, a.pid as pid1, b.pid as pid2, m.marker::int as marker, case when a.pid = b.pid then 3 when a.fatid < 0 and b.fatid < 0 then 1
        when b.fatid = a.pid or b.motid = a.pid or a.fatid = b.pid or a.motid = b.pid then 2 end as r from kp a join kp b on a.famid = b.famid and a.pid <= b.pid, (select unnest([1, 2]) as marker) m)
    select famid, pid1, pid2, marker, coalesce(p0, case when r is not null then (r = 1)::int end)::double as p0, coalesce(p1, case when r is not null then (r = 2)::int end)::double as p1,
        coalesce(p2, case when r is not null then (r = 3)::int end)::double as p2 from w left join t using (famid, pid1, pid2, marker)""")
def ibd_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = varied_pedigree(spark, sf_dir).drop("nation")
    wanted = P.pairs(p).select("famid", "pid1", "pid2", F.explode(F.array(F.lit(1), F.lit(2))).alias("marker"))
    return P.ibd_lookup(wanted, _listed_pairs(spark, sf_dir).drop("nation"), p)


@query(WITH_VARIED + f" select famid, a.pid as pid1, b.pid as pid2, 1 as marker, 2::bigint as n from kp a join kp b using (famid) where a.pid <= b.pid and (a.pid + b.pid + a.nation) % 3 = 0 and a.nation % 2 = 1")
def ibd_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _listed_pairs(spark, sf_dir)
    again = t.withColumn("p0", F.when(F.col("nation") % 2 == 1, F.lit(0.3)).otherwise(F.col("p0")))  # even ones are listed twice alike
    return P.ibd_conflicts(t.drop("nation").unionByName(again.drop("nation")))
