"""Queries for encoders of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.numeric import rounded
from marlstone.operators import encoders as enc
from marlstone.operators import folds, ordering
from marlstone.plans.projections import _NULLED, nulled
from marlstone.plans.registry import query
from marlstone.sources.tables import read


@query(f"with t as ({_NULLED}) select o_orderkey, count(*) over (partition by s) as n, case when s is not null then count(*) over (partition by s) end as n_known from t")
def e01_count_encoding(spark: SparkSession, d: str) -> DataFrame:
    t = enc.counts(nulled(spark, d), "s", "n")
    return enc.counts(t, "s", "n_known", nulls=False).select("o_orderkey", "n", "n_known")


@query("with t as (select p_brand, count(*) as n from part group by 1) select p_partkey, round(n / (select max(n) from t), 6) as f from part join t using (p_brand)")
def e03_relative_frequency(spark: SparkSession, d: str) -> DataFrame:
    return enc.relative_frequency(read(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "f").select("p_partkey", rounded("f", 6).alias("f"))


@query("""with t as (select o_custkey, count(*) as n from orders group by 1),
r as (select o_custkey, case when n > 1 then row_number() over (order by n desc, o_custkey) - 1 else (select count(*) from t where n > 1) end as label from t)
select o_orderkey, cast(label as bigint) as label from orders join r using (o_custkey)""")
def e04_frequency_rank(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return enc.frequency_rank(t, "o_custkey", "label").select("o_orderkey", "label")


@query(f"""with t as ({_NULLED}), f as (select k, row_number() over (order by min(o_orderkey)) - 1 as label from t where k is not null group by k)
select o_orderkey, coalesce(label, -1) as label from t left join f using (k)""")
def e05_first_appearance(spark: SparkSession, d: str) -> DataFrame:
    return enc.first_appearance(nulled(spark, d), "k", ["o_orderkey"], "label").select("o_orderkey", "label")


@query("select p_partkey, cast(dense_rank() over (order by p_brand) - 1 as bigint) as label from part")
def e06_sorted_ids(spark: SparkSession, d: str) -> DataFrame:
    return enc.dense_ids(read(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "label").select("p_partkey", "label")


@query("""with k as (select p_size, dense_rank() over (order by p_size) - 1 as label from (select distinct p_size from part where p_partkey % 20 = 0))
select p_partkey, cast(coalesce(label, -1) as bigint) as label from part left join k using (p_size)""")
def e07_train_ids(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select("p_partkey", "p_size")
    return enc.train_ids(t, "p_size", F.col("p_partkey") % 20 == 0, "label").select("p_partkey", "label")


@query("select p_partkey, cast(dense_rank() over (order by p_size % 3, p_size % 11, p_partkey % 2) - 1 as bigint) as rank from part")
def e09_version_order(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select("p_partkey", F.concat_ws(".", (F.col("p_size") % 3), (F.col("p_size") % 11), (F.col("p_partkey") % 2)).alias("version"))
    v = enc.version_order("version", 3)
    t = t.withColumn("order", v["v0"] * 10_000 + v["v1"] * 100 + v["v2"])
    return enc.dense_ids(t, "order", "rank").select("p_partkey", "rank")


@query(f"with t as ({_NULLED}) select o_orderkey, coalesce(s = 'O', false)::int as s_O, coalesce(s = 'P', false)::int as s_P, coalesce(k = 2, false)::int as k_2 from t")
def e10_one_hot(spark: SparkSession, d: str) -> DataFrame:
    return nulled(spark, d).select("o_orderkey", *enc.one_hot("s", ["O", "P"]), *enc.one_hot("k", [1, 2], drop_first=True))


_CHOSEN = """with t as (select o_orderkey, p_brand as v, (l_quantity > 25)::int as y from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey where l_linenumber = 1),
a as (select avg(y) as m, count(*) as n from t), g as (select v, avg(y) as own, count(*) as k from t group by 1), c as (select v from g, a where k / n >= 0.03 and abs(own - m) > 0.5 * 0.5 / sqrt(k))"""


@query(f"{_CHOSEN} select o_orderkey, coalesce(c.v, '') as flag from t left join c using (v)")
def e12_selected_values(spark: SparkSession, d: str) -> DataFrame:
    """The flag of each row: its value if that is frequent and its mean target is far from the whole."""
    line = read(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), (F.col("l_quantity") > 25).cast("int").alias("y"))
    t = line.join(read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("v")), "p_partkey").join(read(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return enc.selected_flag(t, "v", "y", "flag", 0.03, 0.5).select("o_orderkey", F.coalesce("flag", F.lit("")).alias("flag"))


@query("""with t as (select o_orderkey, o_custkey, (o_totalprice > 150000)::int as y from orders), p as (select avg(y) as prior from t), g as (select o_custkey, avg(y) as m, count(*) as n from t group by 1)
select o_orderkey, round(prior * (1 - 1 / (1 + exp(-(n - 10) / 5.0))) + m / (1 + exp(-(n - 10) / 5.0)), 6) as enc from t join g using (o_custkey), p""")
def e13_smoothed_target(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 150000).cast("int").alias("y"))
    return enc.smoothed_target(t, "o_custkey", "y", "enc", 10, 5.0).select("o_orderkey", rounded("enc", 6).alias("enc"))


@query("""with t as (select o_orderkey, o_custkey, (o_totalprice > 150000)::int as y, cast(('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8)) as bigint) % 5 as f from orders),
c as (select o_custkey, f, sum(y) as s, count(*) as n from t group by all), w as (select o_custkey, sum(s) as s, sum(n) as n from c group by 1), g as (select f, sum(s) as s, sum(n) as n from c group by 1), a as (select sum(s) as s, sum(n) as n from c)
select o_orderkey, round(coalesce((w.s - c.s) / nullif(w.n - c.n, 0), (a.s - g.s) / nullif(a.n - g.n, 0)), 6) as enc from t join c using (o_custkey, f) join w using (o_custkey) join g using (f), a""")
def e14_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 150000).cast("int").alias("y"), folds.fold_of("o_orderkey", 5).alias("f"))
    return enc.out_of_fold_target(t, "o_custkey", "y", "f", "enc").select("o_orderkey", rounded("enc", 6).alias("enc"))


@query("""with g as (select p_brand, avg(p_retailprice) as m from part where p_partkey % 2 = 0 group by 1) select p_partkey, round(coalesce(m, 0), 4) as m from part left join g using (p_brand) where p_partkey % 2 = 1""")
def e15_apply_key_map(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    g = part.where("p_partkey % 2 = 0").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    return part.where("p_partkey % 2 = 1").join(g, "p_brand", "left").select("p_partkey", rounded(F.coalesce("m", F.lit(0.0)), 4).alias("m"))


@query(f"with t as ({_NULLED}) select o_orderkey, coalesce(s, 'nan') || '_' || coalesce(cast(k as varchar), 'nan') as key from t")
def e17_interaction(spark: SparkSession, d: str) -> DataFrame:
    return nulled(spark, d).select("o_orderkey", enc.interaction(["s", "k"]).alias("key"))


@query("select event_id, case when value > 0 and value <= 10 then 'low' when value > 10 and value <= 50 then 'middle' when value > 50 and value <= 90 then 'high' end as bin from events")
def e18_fixed_bins(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", enc.binned("value", [0, 10, 50, 90], ["low", "middle", "high"]).alias("bin"))


@query("""with s as (select min(value) as lo, max(value) as hi from events) select event_id, cast(least(9, floor((value - lo) / ((hi - lo) / 10))) as int) as bin from events, s""")
def e19_equal_width(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators import tabular

    t = tabular.with_scalars(read(spark, d, "events").select("event_id", "value"), lo=F.min("value"), hi=F.max("value"))
    return t.select("event_id", F.least(F.lit(9), F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10))).cast("int").alias("bin"))


@query("""with q as (select quantile_disc(value, 0.25) as a, quantile_disc(value, 0.5) as b, quantile_disc(value, 0.75) as c from events)
select event_id, (value >= a)::int + (value >= b)::int + (value >= c)::int as bin from events, q""")
def e20_equal_frequency(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", "value")
    edges = ordering.percentiles(t, "value", {"a": 0.25, "b": 0.5, "c": 0.75}, interpolate=False)
    at = lambda n: (F.col("value") >= F.col(n)).cast("int")
    return t.crossJoin(F.broadcast(edges)).select("event_id", (at("a") + at("b") + at("c")).alias("bin"))  # one row


@query("""with t as (select p_brand, count(*) as n from part group by 1), r as (select p_brand, coalesce(sum((n > 0.04 * (select count(*) from part))::int) over (order by n desc, p_brand rows between unbounded preceding and 1 preceding), 0) as label from t)
select p_partkey, cast(label as bigint) as grp from part join r using (p_brand)""")
def e21_frequency_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return enc.frequency_cutoff(read(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "grp", 0.04).select("p_partkey", "grp")


_H = "cast(('0x' || substr(md5({}cast(o_orderkey as varchar)), 1, 8)) as bigint)"


@query(f"""with t as (select o_orderkey, o_custkey, o_totalprice as y, {_H.format('')} % 10 as f, {_H.format("'i' || ")} % 5 as g from orders),
c as (select o_custkey, f, g, sum(y) as s, count(*) as n from t group by all), w as (select o_custkey, f, sum(s) as s, sum(n) as n from c group by all), k as (select o_custkey, sum(s) as s, sum(n) as n from c group by 1),
a as (select avg(y) as m from t), o as (select k.o_custkey, i.f, o.g, (k.s - coalesce(w.s, 0) - coalesce(x.s, 0)) / nullif(k.n - coalesce(w.n, 0) - coalesce(x.n, 0), 0) as inner_mean
  from k cross join (select unnest(range(10)) as f) i cross join (select unnest(range(5)) as g) o left join w on w.o_custkey = k.o_custkey and w.f = i.f
  left join (select o_custkey, g, f, s, n from (select o_custkey, g, null as f, sum(s) as s, sum(n) as n from c group by o_custkey, g)) x0 on false
  left join (select c.o_custkey, j.f, c.g, sum(c.s) as s, sum(c.n) as n from c cross join (select unnest(range(10)) as f) j where c.f <> j.f group by all) x on x.o_custkey = k.o_custkey and x.f = i.f and x.g = o.g),
m as (select o_custkey, f, avg(coalesce(inner_mean, (select m from a))) as code from o group by all)
select o_orderkey, round(code, 2) as code from t join m using (o_custkey, f)""")
def e14_nested_impact(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("y"), folds.fold_of("o_orderkey", 10).alias("f"), folds.fold_of("o_orderkey", 5, "i").alias("g"))
    codes, _, _ = enc.nested_impact(t, "o_custkey", "y", "f", "g", 10, 5, "code")
    return codes.select("o_orderkey", rounded("code", 2).alias("code"))


@query("select p_partkey, case when p_size >= 40 then 'high' when p_size >= 20 then 'middle' else 'low' end as band from part")
def e22_bands(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", F.when(s >= 40, "high").when(s >= 20, "middle").otherwise("low").alias("band"))


@query("select p_partkey, p_size // 10 * 10 as low, case when p_size < 40 then p_size // 10 * 10 + 9 end as high from part")
def e23_range_text(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.functions.text import range_bounds

    start = F.expr("p_size div 10 * 10").cast("int")
    t = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 40, F.concat_ws("/", start, start + 9)).otherwise(F.concat(start, F.lit("+"))).alias("r"))
    low, high = range_bounds("r")
    return t.select("p_partkey", low.alias("low"), high.alias("high"))


@query("""select 'o_orderpriority' as "column", count(distinct o_orderpriority) as kinds, count(distinct o_orderpriority) = 2 as binary from orders union all select 'o_orderstatus', count(distinct o_orderstatus), count(distinct o_orderstatus) = 2 from orders""")
def e25_cardinality(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators.aggregates import profile

    p = profile(read(spark, d, "orders").select("o_orderpriority", "o_orderstatus"))
    return p.select("column", F.col("distinct").alias("kinds"), (F.col("distinct") == 2).alias("binary"))


@query("select o_orderkey, cast(('0x' || substr(md5(cast(o_custkey as varchar)), 1, 8)) as bigint) % 16 as bucket from orders")
def e26_hash_bucket(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", folds.fold_of("o_custkey", 16).alias("bucket"))
