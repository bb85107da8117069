"""Queries for dates, numbers, nested data, folds, metrics, blends, graphs and user functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import dates
from marlstone.functions import numeric as num
from marlstone.functions.numeric import rounded
from marlstone.operators import userfuncs
from marlstone.operators import folds, graph, metrics, ordering, tabular
from marlstone.plans.registry import query
from marlstone.sources.tables import read


@query("select event_id, cast(timestamp '2017-12-01 00:00:00' + to_seconds(user_id * 1000) as varchar) as at from events")
def y01_epoch_offset(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", dates.from_offset(F.col("user_id") * 1000, "2017-12-01 00:00:00").cast("string").alias("at"))


@query("select event_id, case when event_id % 5 > 0 then cast(cast(ts as date) as varchar) end as day from events")
def y02_parse_date(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 > 0, F.date_format("ts", "yyMMdd-HHmm")).otherwise("broken").alias("x"))
    return t.select("event_id", F.to_date(F.try_to_timestamp("x", F.lit("yyMMdd-HHmm"))).cast("string").alias("day"))


@query("select event_id, cast(minute(ts) as int) as minute, cast(hour(ts) as int) as hour, cast(day(ts) as int) as day, cast(month(ts) as int) as month, cast(dayofyear(ts) as int) as day_of_year, cast(weekofyear(ts) as int) as week, cast(isodow(ts) - 1 as int) as weekday, (isodow(ts) >= 6) as weekend from events")
def y03_calendar_parts(spark: SparkSession, d: str) -> DataFrame:
    p = dates.parts("ts")
    return read(spark, d, "events").select("event_id", *[p[k].alias(k) for k in ("minute", "hour", "day", "month", "day_of_year", "week", "weekday")], (p["weekday"] >= 5).alias("weekend"))


@query("select o_orderkey, cast((year(o_orderdate) - 1990) * 12 + month(o_orderdate) as int) as running, o_orderdate = last_day(o_orderdate) as month_end, day(o_orderdate) = 1 as month_start, month(o_orderdate) = 12 and day(o_orderdate) = 31 as year_end from (select o_orderkey, cast(o_orderdate as date) as o_orderdate from orders)")
def y06_running_month(spark: SparkSession, d: str) -> DataFrame:
    b = dates.boundaries("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", dates.running_month("o_orderdate", 1990).alias("running"), *[b[k].alias(k) for k in ("month_end", "month_start", "year_end")])


@query("select event_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as int) as days, round(epoch(ts - timestamp '2024-01-01') / 86400.0, 6) as fraction from events")
def y08_day_difference(spark: SparkSession, d: str) -> DataFrame:
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    return read(spark, d, "events").select("event_id", F.datediff("ts", F.lit("2024-01-01")).alias("days"), rounded(dates.day_fraction("ts", start), 6).alias("fraction"))


@query("select event_id, case when hour(ts) between 5 and 11 then 'morning' when hour(ts) between 12 and 16 then 'afternoon' when hour(ts) between 17 and 20 then 'evening' else 'night' end as band, round(sin(2 * pi() * hour(ts) / 24), 6) as s, round(cos(2 * pi() * hour(ts) / 24), 6) as c from events")
def y09_hour_bands(spark: SparkSession, d: str) -> DataFrame:
    s, c = num.cyclic(F.hour("ts"), 24)
    return read(spark, d, "events").select("event_id", dates.hour_band("ts").alias("band"), rounded(s, 6).alias("s"), rounded(c, 6).alias("c"))


@query("select event_id from events where ts >= timestamp '2024-01-15 12:00:00'")
def y12_time_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))).select("event_id")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as int) as age from lineitem join orders on l_orderkey = o_orderkey""")
def y13_age_in_days(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return read(spark, d, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.datediff("l_shipdate", "o_orderdate").alias("age"))


@query("select event_id, cast(hour(ts) as int) as h, cast(minute(ts) as int) as m, cast(month(ts) as int) as code from events")
def y14_packed_numbers(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", (F.hour("ts") * 100 + F.minute("ts")).alias("x"), F.concat(F.lit("c-"), F.month("ts")).alias("c"))
    h, m = dates.hhmm("x")
    return t.select("event_id", h.alias("h"), m.alias("m"), F.split_part("c", F.lit("-"), F.lit(2)).cast("int").alias("code"))


@query("""with s as (select min(ts) as t0 from events) select event_id, cast(round_even(user_id - epoch(ts - t0) / 86400.0, 0) as bigint) as drift, cast(((round_even(user_id - epoch(ts - t0) / 86400.0, 0) % 7) + 7) % 7 as bigint) as m, case when user_id % 10 = 0 then -1 else user_id % 7 end as special from events, s""")
def y17_drift_removal(spark: SparkSession, d: str) -> DataFrame:
    t = tabular.with_scalars(read(spark, d, "events").select("event_id", "user_id", "ts"), t0=F.min("ts"))
    drift = F.bround(F.col("user_id") - dates.day_fraction("ts", "t0")).cast("long")
    return t.select("event_id", drift.alias("drift"), F.pmod(drift, F.lit(7)).alias("m"), F.when(F.col("user_id") % 10 == 0, F.lit(-1).cast("long")).otherwise(F.pmod("user_id", F.lit(7))).alias("special"))


@query("select c_custkey, case when c_acctbal > 0 then round(ln(c_acctbal), 6) end as ln, round(sqrt(abs(c_acctbal)), 6) as root, round(ln(1 + abs(c_acctbal)), 6) as ln1p, cast(round_even(ln(1 + abs(c_acctbal)), 0) as int) as bucket, round(c_acctbal - floor(c_acctbal), 4) as cents, cast(ceil(c_acctbal) - floor(c_acctbal) as int) as odd from customer")
def v01_numbers(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return read(spark, d, "customer").select(
        "c_custkey", rounded(num.safe_log(b), 6).alias("ln"), rounded(F.sqrt(F.abs(b)), 6).alias("root"), rounded(F.log1p(F.abs(b)), 6).alias("ln1p"),
        num.half_even(F.log1p(F.abs(b))).cast("int").alias("bucket"), rounded(num.floor_fraction(b), 4).alias("cents"), num.has_fraction(b).alias("odd"),
    )


@query("select p_partkey, round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) as diagonal, round(p_size / p_retailprice, 6) as ratio, round(0.3 * p_size + 0.7 * p_retailprice, 6) as score from part")
def v04_ratios(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("p_size"), F.col("p_retailprice")
    return read(spark, d, "part").select("p_partkey", rounded(F.hypot(s, p), 6).alias("diagonal"), rounded(s / p, 6).alias("ratio"), rounded(0.3 * s + 0.7 * p, 6).alias("score"))


@query("""with s as (select min(c_acctbal) as lo, max(c_acctbal) as hi, avg(c_acctbal) as m, stddev_pop(c_acctbal) as sd from customer) select c_custkey, round((c_acctbal - lo) / (hi - lo), 6) as unit, round((c_acctbal - m) / sd, 6) as z from customer, s""")
def v07_scaling(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    t = tabular.with_scalars(read(spark, d, "customer"), lo=F.min(b), hi=F.max(b), m=F.avg(b), sd=F.stddev_pop(b))
    return t.select("c_custkey", rounded((b - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("unit"), rounded((b - F.col("m")) / F.col("sd"), 6).alias("z"))


@query("""with t as (select vec_id, list_transform(embedding[1:4], lambda x: cast(x as double)) as v from embeddings), e as (select vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) as x from t)
select vec_id, round(x[1] / list_sum(x), 6) as p1, round(1 / (1 + exp(-v[1])), 6) as s1, round(v[1] / sqrt(list_sum(list_transform(v, lambda y: y * y))), 5) as u1, round(v[2] / list_sum(list_transform(v, lambda y: abs(y))), 5) as a2 from e""")
def v08_vector_functions(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    t = read(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return t.select("vec_id", rounded(num.softmax(F.col("v"))[0], 6).alias("p1"), rounded(num.sigmoid(F.col("v")[0]), 6).alias("s1"), rounded(num.normalised(F.col("v"))[0], 5).alias("u1"), rounded(num.normalised(F.col("v"), 1)[1], 5).alias("a2"))


@query("""with t as (select vec_id, list_transform(embedding[1:10], lambda x: cast(abs(x) as double)) as w from embeddings), m as (select vec_id, w, list_sum(list_transform(range(1, 11), lambda i: w[i] * i)) / list_sum(w) as m from t)
select vec_id, round(m, 5) as mean, round(sqrt(list_sum(list_transform(range(1, 11), lambda i: w[i] * (i - m) * (i - m))) / list_sum(w)), 5) as spread from m""")
def v09_expected_score(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double"))).alias("w"))
    mean, spread = num.expected(F.col("w"), range(1, 11))
    return t.select("vec_id", rounded(mean, 5).alias("mean"), rounded(spread, 5).alias("spread"))


@query("select event_id, cast(coalesce(json_extract(props, '$.k'), '-1') as bigint) as k, coalesce(json_extract_string(props, '$.none'), 'missing') as other, json_extract(props, '$.none') is not null as has from events")
def q01_json_paths(spark: SparkSession, d: str) -> DataFrame:
    j = lambda p: F.get_json_object("props", p)
    return read(spark, d, "events").select("event_id", F.coalesce(j("$.k").try_cast("long"), F.lit(-1).cast("long")).alias("k"), F.coalesce(j("$.none"), F.lit("missing")).alias("other"), j("$.none").isNotNull().alias("has"))


@query("select vec_id, embedding[3] as third, embedding[99] as none, round(list_avg(embedding), 5) as mean, list_max(embedding) as high, list_min(embedding) as low, cast(len(embedding) as int) as n from embeddings")
def q02_array_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    mean = num.total(F.transform(e, lambda x: x.cast("double"))) / F.size(e)
    return read(spark, d, "embeddings").select("vec_id", F.try_element_at(e, F.lit(3)).alias("third"), F.try_element_at(e, F.lit(99)).alias("none"), rounded(mean, 5).alias("mean"), F.array_max(e).alias("high"), F.array_min(e).alias("low"), F.size(e).alias("n"))


@query("select user_id, round(avg(cast(json_extract(props, '$.k') as double)), 5) as mean_k, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as sum_k, string_agg(event_type, ',' order by ts, event_id) as kinds from events group by user_id")
def q09_entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "struct<k:long>")["k"]
    t = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type", k.alias("k"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return t.groupBy("user_id").agg(rounded(F.avg("k"), 5).alias("mean_k"), F.sum("k").alias("sum_k"), F.array_join(kinds, ",").alias("kinds"))


@query("""with t as (select vec_id, embedding[1:8] as a, embedding[9:16] as b from embeddings) select vec_id, round(list_sum(list_transform(range(1, 9), lambda i: cast(a[i] as double) + b[i])), 4) as both, round((a[1] - list_min(a)) / (list_max(a) - list_min(a)), 4) as unit, cast(a[2] as double) as shifted from t""")
def q11_array_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("a"), F.slice("embedding", 9, 8).alias("b"))
    a = F.col("a")
    both = num.total(F.zip_with("a", "b", lambda x, y: x.cast("double") + y))
    moved = F.concat(F.slice(a, 2, 7), F.array(F.lit(0.0).cast("float")))  # shifted left, zero filled
    return t.select("vec_id", rounded(both, 4).alias("both"), rounded((a[0] - F.array_min(a)) / (F.array_max(a) - F.array_min(a)), 4).alias("unit"), moved[0].cast("double").alias("shifted"))


@query("select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by 1")
def q13_multimap(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


_HASH = "cast(('0x' || substr(md5(cast({} as varchar)), 1, 8)) as bigint)"


@query(f"select o_orderkey from orders where {_HASH.format('o_orderkey')} < cast(0.1 * 4294967296 as bigint)")
def f01_sample(spark: SparkSession, d: str) -> DataFrame:
    return folds.sampled(read(spark, d, "orders"), "o_orderkey", 0.1).select("o_orderkey")


@query(f"select o_orderkey from orders where o_totalprice > 250000 or {_HASH.format('o_orderkey')} < cast(0.2 * 4294967296 as bigint)")
def f02_down_sample(spark: SparkSession, d: str) -> DataFrame:
    return folds.down_sampled(read(spark, d, "orders"), "o_orderkey", F.col("o_totalprice") > 250000, 0.2).select("o_orderkey")


@query(f"select o_orderkey, {_HASH.format('o_orderkey')} % 5 as fold, (row_number() over (partition by o_orderstatus order by {_HASH.format('o_orderkey')}, o_orderkey) - 1) % 5 as strat from orders")
def f04_folds(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", folds.fold_of("o_orderkey", 5).alias("fold"))
    return folds.stratified(t, "o_orderkey", "o_orderstatus", 5, "strat").select("o_orderkey", "fold", "strat")


@query("""with f(fold, t0, t1, v0, v1) as (values (0, 0, 10, 12, 16), (1, 4, 14, 16, 20), (2, 8, 18, 20, 24), (3, 12, 22, 24, 28)), e as (select event_id, date_diff('day', date '2024-01-01', cast(ts as date)) as day from events)
select fold, case when day between t0 and t1 then 'train' else 'valid' end as part, count(*) as n from e, f where day between t0 and t1 or day between v0 and v1 group by all""")
def f06_sliding_folds(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", F.datediff("ts", F.lit("2024-01-01")).alias("day"))
    return folds.in_folds(t, "day", folds.sliding(0, 29, 10, 2, 4, 4)).groupBy("fold", "part").agg(F.count("*").alias("n"))


@query("with s as (select min(ts) as lo, max(ts) as hi from events) select event_id, case when epoch(ts - lo) < 0.75 * epoch(hi - lo) then 'train' else 'valid' end as part from events, s")
def f09_time_split(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = tabular.with_scalars(read(spark, d, "events").select("event_id", us.alias("us")), lo=F.min("us"), hi=F.max("us"))
    return t.select("event_id", F.when((F.col("us") - F.col("lo")) / 1e6 < 0.75 * ((F.col("hi") - F.col("lo")) / 1e6), "train").otherwise("valid").alias("part"))


@query("select event_id from events where event_id % 4 = 1 and event_id < (select count(*) // 4 * 4 from events)")
def f10_strided_shard(spark: SparkSession, d: str) -> DataFrame:
    t = tabular.with_scalars(read(spark, d, "events").select("event_id"), n=F.count("*"))
    return t.where((F.pmod("event_id", F.lit(4)) == 1) & (F.col("event_id") < F.expr("n div 4 * 4"))).select("event_id")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", rounded(F.col("o_totalprice") / 1000, 0).alias("s"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


_SCORED = "(select o_orderkey, round(o_totalprice / 1000, 0) as s, (o_orderstatus = 'F')::int as y from orders)"


@query(f"with r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as r from {_SCORED}) select round((sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::double * sum(1 - y)), 8) as auc from r")
def x01_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(scored(spark, d), "s", "y").select(rounded("auc", 8).alias("auc"))


@query("""with t as (select quality as a, toxic as p from labels), c as (select count(*) as n, sum(a * p) as tp, sum(p) as pp, sum(a) as ap, count(*) filter (a = p) as ok from t)
select round(ok / n, 6) as accuracy, round(tp / pp, 6) as precision, round(tp / ap, 6) as recall, round(2 * (tp / pp) * (tp / ap) / (tp / pp + tp / ap), 6) as f1 from c""")
def x02_classification(spark: SparkSession, d: str) -> DataFrame:
    t = metrics.classification(read(spark, d, "labels"), "quality", "toxic")
    return t.select(*[rounded(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("with t as (select l_extendedprice as a, l_quantity * 1500.0 as p from lineitem) select round(sqrt(avg((a - p) * (a - p))), 4) as rmse, round(avg(abs(a - p)), 4) as mae, round(1 - avg((a - p) * (a - p)) / var_pop(a), 6) as r2 from t")
def x03_regression(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1500.0).alias("p"))
    return metrics.regression(t, "a", "p").select(rounded("rmse", 4).alias("rmse"), rounded("mae", 4).alias("mae"), rounded("r2", 6).alias("r2"))


@query("select round(-avg(ln(least(greatest(case when event_type = 'click' then value / 100 else 1 - value / 100 end, 0.001), 0.999))), 6) as log_loss from events")
def x04_log_loss(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("event_type") == "click", F.col("value") / 100).otherwise(1 - F.col("value") / 100)
    return metrics.log_loss(read(spark, d, "events"), p, 0.001).select(rounded("log_loss", 6).alias("log_loss"))


@query("""with t as (select p_size % 5 as a, (p_size // 2) % 5 as p from part), c as (select a, p, count(*) as n from t group by all), r as (select a, sum(n) as na from c group by 1), k as (select p, sum(n) as np from c group by 1)
select round(1 - (select sum((a - p) * (a - p) * n) * sum(n) from c) / (select sum((a - p) * (a - p) * na * np) from r, k)::double, 6) as kappa""")
def x05_quadratic_kappa(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select((F.col("p_size") % 5).alias("a"), F.expr("(p_size div 2) % 5").alias("p"))
    return metrics.quadratic_kappa(t, "a", "p").select(rounded("kappa", 6).alias("kappa"))


@query(f"""with g as (select s, sum(y)::double as pos, sum(1 - y)::double as neg from {_SCORED} group by 1), r as (select s, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as q from g window w as (order by s desc rows unbounded preceding)),
m as (select s, coalesce((tp * (q - fp) - fp * (p - tp)) / nullif(sqrt((tp + fp) * p * q * (q - fp + p - tp)), 0), 0) as mcc from r)
select s as threshold, round(mcc, 6) as mcc from m order by round(mcc, 9) desc, s desc limit 1""")
def x06_best_mcc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_mcc(scored(spark, d), "s", "y").select("threshold", rounded("mcc", 6).alias("mcc"))


@query(f"with t as (select s, (o_orderkey % 2)::int as y from {_SCORED}), r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as r from t) select round((sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::double * sum(1 - y)), 8) as auc from r")
def x08_shift_auc(spark: SparkSession, d: str) -> DataFrame:
    t = scored(spark, d).withColumn("split", (F.col("o_orderkey") % 2).cast("int"))
    return metrics.roc_auc(t, "s", "split").select(rounded("auc", 8).alias("auc"))


@query("select event_id, (value >= 50)::int as flag, case when value < 10 then 0 when value < 30 then 1 when value < 60 then 2 when value < 90 then 3 else 4 end as level from events")
def x10_thresholds(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return read(spark, d, "events").select("event_id", (v >= 50).cast("int").alias("flag"), F.when(v < 10, 0).when(v < 30, 1).when(v < 60, 2).when(v < 90, 3).otherwise(4).alias("level"))


@query("""with a as (select event_id, value / 100 as p from events), b as (select event_id, (100 - value) / 120 as p from events)
select event_id, round(0.7 * a.p + 0.3 * b.p, 6) as mean, round(case when a.p > 0 and b.p > 0 then exp(0.7 * ln(a.p) + 0.3 * ln(b.p)) end, 6) as geometric, case when a.p >= 0.977 then 0.999 else round(a.p, 6) end as clamped from a join b using (event_id)""")
def b01_blends(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    a, b = e.select("event_id", (F.col("value") / 100).alias("p")), e.select("event_id", ((100 - F.col("value")) / 120).alias("q"))
    p, q = F.col("p"), F.col("q")
    geometric = F.exp(0.7 * num.safe_log(p) + 0.3 * num.safe_log(q))
    return a.join(b, "event_id").select("event_id", rounded(0.7 * p + 0.3 * q, 6).alias("mean"), rounded(geometric, 6).alias("geometric"), F.when(p >= 0.977, 0.999).otherwise(rounded(p, 6)).alias("clamped"))


@query("select user_id, round(avg(value), 6) as mean, round(avg(abs(value)), 6) as absolute from events group by 1")
def b03_mean_over_runs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(rounded(F.avg("value"), 6).alias("mean"), rounded(F.avg(F.abs("value")), 6).alias("absolute"))


@query("""with r as (select p_partkey, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0::double as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0::double as b from part) select p_partkey, round((a + b) / 2, 4) as r from r""")
def b04_rank_average(spark: SparkSession, d: str) -> DataFrame:
    t = ordering.average_rank(read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "a")
    return ordering.average_rank(t, "p_retailprice", "b").select("p_partkey", rounded((F.col("a") + F.col("b")) / 2, 4).alias("r"))


@query("select round(corr(value, user_id), 8) as r from events")
def b07_submission_correlation(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").agg(rounded(F.corr("value", "user_id"), 8).alias("r"))


_EDGES = "(select distinct user_id as a, user_id + cast(floor(value) as bigint) * 7 as b from events)"
_BOTH = f"e as (select a, b from {_EDGES} union select b, a from {_EDGES})"
_HOPS = """r(node, hops) using key (node) as (select 1::bigint, 0 union
           (select e.b, min(r.hops) + 1 from r join e on r.node = e.a left join recurring.r k on k.node = e.b where k.node is null group by e.b))"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("a"), (F.col("user_id") + F.floor("value") * 7).alias("b")).distinct()


@query(f"""with recursive {_BOTH}, r(node, component) using key (node) as (select a, a from e union
           (select e.b, min(r.component) from r join e on r.node = e.a join recurring.r k on k.node = e.b where r.component < k.component group by e.b))
select node, component from r""")
def g01_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(edges(spark, d), "a", "b")


@query(f"with recursive {_BOTH}, {_HOPS} select node, hops from r")
def g02_reach(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([(1,)], "node long")
    return graph.reach(edges(spark, d), "a", "b", start, "node")


@query(f"""with recursive {_BOTH}, {_HOPS}, g as (select distinct user_id as node from events where value > 99.5)
select node, hops from r where node in (select node from g) order by hops, node limit 1""")
def g02_nearest_goal(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([(1,)], "node long")
    goals = read(spark, d, "events").where("value > 99.5").select(F.col("user_id").alias("node"))
    return graph.nearest(edges(spark, d), "a", "b", start, "node", goals)


@query("select n_name as a, r_name as b from nation join region on n_regionkey = r_regionkey union select r_name, n_name from nation join region on n_regionkey = r_regionkey")
def g03_two_way_dictionary(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.select(F.col("n_name").alias("a"), F.col("r_name").alias("b")).union(t.select("r_name", "n_name")).distinct()


@query("select event_id, value * 2 + user_id as v from events")
def h01_row_functions(spark: SparkSession, d: str) -> DataFrame:
    """A lambda over columns, as an expression."""
    return read(spark, d, "events").select("event_id", (F.col("value") * 2 + F.col("user_id")).alias("v"))


@query("select user_id, round(max(value) - avg(value), 4) as spread, count(*) as n from events group by 1")
def h03_user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("user_id", "value")
    spread = userfuncs.Aggregate(partial=lambda x: [x.max(), x.sum(), len(x)], merge=lambda a, b: [max(a[0], b[0]), a[1] + b[1], a[2] + b[2]], finish=lambda s: s[0] - s[1] / s[2])
    return userfuncs.aggregate(t, ["user_id"], "value", spread, "spread").select("user_id", rounded("spread", 4).alias("spread"), F.col("n"))


@query("select event_id, cast(length(props) + 1 as bigint) as n from events")
def h06_partition_map(spark: SparkSession, d: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"event_id": batch["event_id"], "n": batch["props"].str.len() + 1})

    return read(spark, d, "events").select("event_id", "props").mapInPandas(work, "event_id long, n long")


