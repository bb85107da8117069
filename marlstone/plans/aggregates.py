"""Queries for aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.numeric import rounded
from marlstone.operators import aggregates as agg
from marlstone.operators import ordering
from marlstone.plans.projections import _NULLED, nulled
from marlstone.plans.registry import query
from marlstone.sources.tables import read

G1 = "case when count(x) >= 3 then case when stddev_pop(x) = 0 then 0.0 else skewness(x) end end"
G2 = "case when count(x) >= 4 then case when stddev_pop(x) = 0 then 0.0 else kurtosis(x) end end"


@query(f"select k, count(*) as n, count(s) as n_s, count(distinct s) as kinds from ({_NULLED}) where k is not null group by k")
def a01_counts(spark: SparkSession, d: str) -> DataFrame:
    t = nulled(spark, d).where("k is not null")
    return t.groupBy("k").agg(F.count("*").alias("n"), F.count("s").alias("n_s"), F.count_distinct("s").alias("kinds"))


@query("select o_custkey, round(coalesce(sum(o_totalprice), 0), 4) as o_totalprice_sum, round(avg(o_totalprice), 4) as o_totalprice_mean, round(stddev_samp(o_totalprice), 4) as o_totalprice_std, min(o_totalprice) as o_totalprice_min, max(o_totalprice) as o_totalprice_max from orders group by o_custkey")
def a04_sum_mean_std(spark: SparkSession, d: str) -> DataFrame:
    return agg.aggregate(read(spark, d, "orders"), ["o_custkey"], {"o_totalprice": ["sum", "mean", "std", "min", "max"]}, 4)


@query("select o_custkey, round(median(o_totalprice), 4) as o_totalprice_median, round(var_samp(o_totalprice), 2) as o_totalprice_var from orders group by o_custkey")
def a06_median_variance(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_custkey", "o_totalprice")
    medians = ordering.group_percentiles(t, ["o_custkey"], "o_totalprice", {"m": 0.5})
    spread = t.groupBy("o_custkey").agg(rounded(F.var_samp("o_totalprice"), 2).alias("o_totalprice_var"))
    return medians.join(spread, "o_custkey").select("o_custkey", rounded("m", 4).alias("o_totalprice_median"), "o_totalprice_var")


@query(f"select o_custkey, round({G1.replace('x', 'o_totalprice')}, 5) as skew, round({G2.replace('x', 'o_totalprice')}, 5) as kurt from orders group by o_custkey".replace("mao_totalprice", "max"))
def a08_skew_kurtosis(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").groupBy("o_custkey")
    return t.agg(rounded(agg.skewness("o_totalprice"), 5).alias("skew"), rounded(agg.kurtosis("o_totalprice"), 5).alias("kurt"))


@query("select o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) as q25, round(quantile_cont(o_totalprice, 0.75), 4) as q75, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) as iqr, round(quantile_cont(o_totalprice, 0.1), 4) as q10, round(quantile_cont(o_totalprice, 0.9), 4) as q90 from orders group by o_orderpriority")
def a10_quantiles(spark: SparkSession, d: str) -> DataFrame:
    t = ordering.group_percentiles(read(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", {"a": 0.1, "b": 0.25, "c": 0.75, "e": 0.9})
    r = lambda x, n: rounded(x, 4).alias(n)
    return t.select("o_orderpriority", r(F.col("b"), "q25"), r(F.col("c"), "q75"), r(F.col("c") - F.col("b"), "iqr"), r(F.col("a"), "q10"), r(F.col("e"), "q90"))


@query("select l_returnflag, l_linestatus, count(l_quantity) as l_quantity_count, round(avg(l_quantity), 4) as l_quantity_mean, round(max(l_extendedprice), 2) as l_extendedprice_max, count(distinct l_suppkey) as l_suppkey_nunique from lineitem group by all")
def a12_many_statistics(spark: SparkSession, d: str) -> DataFrame:
    spec = {"l_quantity": ["count", "mean"], "l_extendedprice": ["max"], "l_suppkey": ["nunique"]}
    return agg.aggregate(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], spec, 4)


@query("select p_brand, string_agg(distinct p_type, ',' order by p_type) as types, count(distinct p_type) as n from part group by p_brand")
def a15_distinct_joined(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("s"))
    return t.select("p_brand", F.array_join("s", ",").alias("types"), F.size("s").cast("long").alias("n"))


@query("""select p_brand, cast(sum(w) as bigint) as score from (select distinct p_brand, p_type, length(p_type) as w from part) group by p_brand""")
def a16_set_score(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select("p_brand", "p_type").distinct()
    return t.groupBy("p_brand").agg(F.sum(F.length("p_type")).alias("score"))


@query("select event_type, count(value) as value_count, round(avg(value), 6) as value_mean, round(stddev_samp(value), 6) as value_std, round(min(value), 6) as value_min, round(quantile_cont(value, 0.25), 6) as value_q25, round(median(value), 6) as value_median, round(quantile_cont(value, 0.75), 6) as value_q75, round(max(value), 6) as value_max from events group by event_type")
def a17_describe(spark: SparkSession, d: str) -> DataFrame:
    return agg.describe(read(spark, d, "events"), ["event_type"], "value")


@query(f"select s, count(*) as n from ({_NULLED}) where s is not null group by s")
def a19_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return agg.value_counts(nulled(spark, d), "s")


@query(f"select s, round(count(*) / sum(count(*)) over (), 6) as share from ({_NULLED}) group by s")
def a20_value_shares(spark: SparkSession, d: str) -> DataFrame:
    return agg.value_counts(nulled(spark, d), "s", normalize=True, dropna=False).select("s", rounded("share", 6).alias("share"))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def a22_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events) where n = 1")
def a23_first_of_key(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return agg.first_by(t, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view, round(avg((event_type = 'click')::int), 6) as click_norm from events group by user_id")
def a24_pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").groupBy("user_id")
    n = lambda v: F.count_if(F.col("event_type") == v)
    return t.agg(n("click").alias("click"), n("view").alias("view"), rounded(n("click") / F.count("*"), 6).alias("click_norm"))


@query("select variable, value, count(*) as n from (select o_orderstatus as s, o_orderpriority as p from orders) unpivot (value for variable in (s, p)) group by all")
def a25_melt_counts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    return t.unpivot([], ["s", "p"], "variable", "value").groupBy("variable", "value").agg(F.count("*").alias("n"))


@query("select cast(cast(ts as date) as varchar) as day, round(sum(value), 4) as total, count(*) as n from events group by 1")
def a26_daily_totals(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(rounded(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


_ROWS = "select o_orderkey, case when o_totalprice > 100000 then o_totalprice end as a, cast(o_custkey as double) as b, nullif(cast(o_custkey % 3 as double), 0) as c from orders"


@query(f"""select o_orderkey, round(list_avg(list_filter([a, b, c], lambda x: x is not null)), 4) as mean, round(list_stddev_samp(list_filter([a, b, c], lambda x: x is not null)), 4) as std,
round(list_max([a, b, c]), 4) as high, round(list_min([a, b, c]), 4) as low, cast(len(list_distinct([a, b, c])) as int) as kinds, cast(len(list_filter([a, b, c], lambda x: x > 0)) as int) as positive from ({_ROWS})""")
def a27_row_statistics(spark: SparkSession, d: str) -> DataFrame:
    c, names = F.col, ["a", "b", "c"]
    p = c("o_totalprice")
    t = read(spark, d, "orders").select("o_orderkey", F.when(p > 100000, p).alias("a"), c("o_custkey").cast("double").alias("b"), F.nullif((c("o_custkey") % 3).cast("double"), F.lit(0.0)).alias("c"))
    every = F.array(*names)
    return t.select(
        "o_orderkey", rounded(agg.row_mean(names), 4).alias("mean"), rounded(agg.row_std(names), 4).alias("std"),
        rounded(F.array_max(every), 4).alias("high"), rounded(F.array_min(every), 4).alias("low"),
        F.size(F.array_distinct(F.array_compact(every))).alias("kinds"), F.size(F.filter(every, lambda x: x > 0)).alias("positive"),
    )


@query(f"""select 's' as "column", count(*) filter (s is null) as nulls from ({_NULLED}) union all select 'p', count(*) filter (p is null) from ({_NULLED}) union all select 'k', count(*) filter (k is null) from ({_NULLED})""")
def a31_null_profile(spark: SparkSession, d: str) -> DataFrame:
    one = nulled(spark, d).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("s", "p", "k")])
    return one.unpivot([], ["s", "p", "k"], "column", "nulls")


@query("select cast(0 as bigint) as nulls, 'r_name,r_regionkey' as columns")
def a32_null_signature(spark: SparkSession, d: str) -> DataFrame:
    return agg.null_signature(read(spark, d, "region").select("r_regionkey", "r_name"))


@query(f"""with t as (select cast(s as varchar) as s, cast(k as varchar) as k from ({_NULLED})), u as (select 's' as "column", s as value from t union all select 'k', k from t),
c as (select "column", value, count(*) as n from u group by all)
select "column", count(value) as "distinct", round(coalesce(sum(n) filter (value is null), 0) / sum(n), 6) as null_share, round(max(n) filter (value is not null) / sum(n), 6) as top_share from c group by 1""")
def a33_column_profile(spark: SparkSession, d: str) -> DataFrame:
    p = agg.profile(nulled(spark, d).select("s", "k"))
    return p.select("column", "distinct", rounded("null_share", 6).alias("null_share"), rounded("top_share", 6).alias("top_share"))


@query("select round(sum(l_extendedprice), 2) as total, count(*) as n from lineitem")
def a34_grand_total(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").agg(rounded(F.sum("l_extendedprice"), 2).alias("total"), F.count("*").alias("n"))


@query("""with cells as (select s, p, b from (select distinct o_orderstatus as s from orders), (select distinct o_orderpriority as p from orders), (select unnest([0, 1, 2, 3]) as b)),
m as (select o_orderstatus as s, o_orderpriority as p, cast(least(3, floor(o_totalprice / 100000)) as int) as b, avg(o_totalprice) as v from orders group by all)
select s, p, cast(b as int) as b, round(coalesce(v, 0), 4) as mean from cells left join m using (s, p, b)""")
def a35_cell_means(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.least(F.lit(3), F.floor(F.col("o_totalprice") / 100000)).cast("int").alias("b"), "o_totalprice")
    m = t.groupBy("s", "p", "b").agg(F.avg("o_totalprice").alias("v"))
    grid = t.select("s").distinct().crossJoin(t.select("p").distinct()).crossJoin(spark.range(4).select(F.col("id").cast("int").alias("b")))  # value lists of a few rows
    return grid.join(m, ["s", "p", "b"], "left").select("s", "p", "b", rounded(F.coalesce("v", F.lit(0.0)), 4).alias("mean"))


@query("select l_shipmode as g, 0.0 as share from (select 'x' as l_shipmode) where false union all select l_returnflag, round(avg((l_quantity > 25)::int), 6) from lineitem group by 1")
def a36_proportion(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(rounded(F.avg((F.col("l_quantity") > 25).cast("int")), 6).alias("share"))


@query("select quality as actual, toxic as predicted, count(*) as n from labels group by all")
def a37_confusion(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").groupBy(F.col("quality").alias("actual"), F.col("toxic").alias("predicted")).agg(F.count("*").alias("n"))


@query("select 'l_quantity' as x, 'l_extendedprice' as y, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem union all select 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) from lineitem union all select 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) from lineitem")
def a39_correlations(spark: SparkSession, d: str) -> DataFrame:
    return agg.correlation(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).withColumn("r", rounded("r", 6))


@query("""with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part) select round(corr(a, b), 6) as spearman from r""")
def a40_spearman(spark: SparkSession, d: str) -> DataFrame:
    t = ordering.average_rank(read(spark, d, "part").select("p_size", "p_retailprice"), "p_size", "a")
    return ordering.average_rank(t, "p_retailprice", "b").agg(rounded(F.corr("a", "b"), 6).alias("spearman"))


@query("select o_custkey, min_by(o_orderkey, (o_totalprice, o_orderkey)) as cheapest, max_by(o_orderkey, (o_totalprice, o_orderkey)) as dearest from orders group by o_custkey")
def a42_arg_extremes(spark: SparkSession, d: str) -> DataFrame:
    by = F.struct("o_totalprice", "o_orderkey")
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", by).alias("cheapest"), F.max_by("o_orderkey", by).alias("dearest"))


@query("select o_custkey, count(distinct o_orderstatus) = 1 as determined from orders group by o_custkey")
def a43_dependency(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg((F.min("o_orderstatus") == F.max("o_orderstatus")).alias("determined"))


@query("select l_suppkey, count(*) filter (l_returnflag = 'R') as returned from lineitem group by l_suppkey")
def a44_conditional_count(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query("select unnest([0.01, 0.05, 0.5, 0.95, 0.99]) as share, round(unnest(quantile_cont(l_extendedprice, [0.01, 0.05, 0.5, 0.95, 0.99])), 4) as value from lineitem".replace("[0.01", "[cast(0.01 as double)", 1))
def a45_percentile_list(spark: SparkSession, d: str) -> DataFrame:
    shares = [0.01, 0.05, 0.5, 0.95, 0.99]
    one = ordering.percentiles(read(spark, d, "lineitem"), "l_extendedprice", {f"s{k}": x for k, x in enumerate(shares)})
    rows = F.array(*[F.struct(F.lit(x).alias("share"), rounded(F.col(f"s{k}"), 4).alias("value")) for k, x in enumerate(shares)])
    return one.select(F.inline(rows))
