"""Queries for window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.numeric import rounded
from marlstone.operators import aggregates as agg
from marlstone.operators import ordering, tabular
from marlstone.operators import windows as win
from marlstone.plans.registry import query
from marlstone.sources.tables import read

DAY = 86_400


@query("select event_id, count(*) over (partition by user_id) as n, min(value) over (partition by user_id) as low, max(value) over (partition by user_id) as high from events")
def w01_group_broadcast(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", "user_id", "value")
    return agg.join_back(t, ["user_id"], F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).select("event_id", "n", "low", "high")


@query("select event_id, round(count(*) over (partition by event_type) / (select count(*) from events), 6) as share from events")
def w02_group_share(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", "event_type")
    shares = agg.value_counts(t, "event_type", normalize=True)
    return t.join(F.broadcast(shares), "event_type").select("event_id", rounded("share", 6).alias("share"))  # a handful of event types


@query("select event_id, round(value - avg(value) over (partition by user_id), 6) as off_mean, round(value - median(value) over (partition by user_id), 6) as off_median from events")
def w03_deviation(spark: SparkSession, d: str) -> DataFrame:
    t = agg.join_back(read(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], F.avg("value").alias("m"), F.median("value").alias("d"))
    return t.select("event_id", rounded(F.col("value") - F.col("m"), 6).alias("off_mean"), rounded(F.col("value") - F.col("d"), 6).alias("off_median"))


@query("""with t as (select event_id, value, min(value) over (partition by cast(ts as date)) as lo, max(value) over (partition by cast(ts as date)) as hi from events)
select event_id, round((value - lo) / nullif(hi - lo, 0), 6) as scaled, case when value > lo then round(log10(value - lo), 6) end as logged from t""")
def w05_scale_in_period(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", "value", F.to_date("ts").alias("day"))
    t = agg.join_back(t, ["day"], F.min("value").alias("lo"), F.max("value").alias("hi"))
    above = F.col("value") - F.col("lo")
    return t.select("event_id", rounded(F.try_divide(above, F.col("hi") - F.col("lo")), 6).alias("scaled"), F.when(above > 0, rounded(F.log10(above), 6)).alias("logged"))


@query("select o_orderkey, round((o_totalprice - (select avg(o_totalprice) from orders)) / (select stddev_samp(o_totalprice) from orders), 6) as z from orders")
def w06_standardise(spark: SparkSession, d: str) -> DataFrame:
    t = tabular.with_scalars(read(spark, d, "orders"), m=F.avg("o_totalprice"), s=F.stddev_samp("o_totalprice"))
    return t.select("o_orderkey", rounded((F.col("o_totalprice") - F.col("m")) / F.col("s"), 6).alias("z"))


_W7 = "(partition by o_custkey order by o_orderdate range between interval '6 days 23 hours 59 minutes 59.999999 seconds' preceding and current row)"


@query(f"select o_orderkey, round(avg(o_totalprice) over {_W7}, 4) as mean7, round(stddev_samp(o_totalprice) over {_W7}, 4) as std7, count(*) over {_W7} as n7 from orders")
def w07_trailing_window(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    made = {"m": F.avg("o_totalprice"), "s": F.stddev_samp("o_totalprice"), "n7": F.count("*")}
    t = win.trailing_features(t, ["o_custkey"], "o_orderdate", 7 * DAY, made)
    return t.select("o_orderkey", rounded("m", 4).alias("mean7"), rounded("s", 4).alias("std7"), "n7")


_W30 = _W7.replace("6 days", "29 days")


@query(f"""select o_orderkey, round((select sum(p.o_totalprice) from orders p where p.o_custkey = o.o_custkey and p.o_orderdate > o.o_orderdate - interval 30 days and (p.o_orderdate, p.o_orderkey) <= (o.o_orderdate, o.o_orderkey))
 / (select count(*) from orders p where p.o_custkey = o.o_custkey and p.o_orderdate > o.o_orderdate - interval 30 days and (p.o_orderdate, p.o_orderkey) <= (o.o_orderdate, o.o_orderkey)), 4) as mean30 from orders o""")
def w07_trailing_positional(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    t = win.trailing_positional(t, ["o_custkey"], "o_orderdate", "o_orderkey", 30 * DAY, "o_totalprice", "m")
    return t.select("o_orderkey", rounded("m", 4).alias("mean30"))


@query(f"""with t as (select distinct on (o_custkey, o_orderdate) o_custkey, o_orderdate, avg(o_totalprice) over {_W30} as m from orders)
select o_orderkey, round(o_totalprice - m, 4) as diff from orders join t using (o_custkey, o_orderdate)""")
def w08_trailing_difference(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    t = win.trailing_features(t, ["o_custkey"], "o_orderdate", 30 * DAY, {"m": F.avg("o_totalprice")})
    return t.select("o_orderkey", rounded(F.col("o_totalprice") - F.col("m"), 4).alias("diff"))


@query("select event_id, case when count(value) over w >= 7 then round(sum(value) over w, 4) end as total from events window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)")
def w09_min_periods(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    t = read(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return t.select("event_id", rounded(win.at_least(F.sum("value"), w, "value", 7), 4).alias("total"))


@query("select event_id, count(*) over (partition by user_id, event_type order by ts range between interval '13 days 23 hours 59 minutes 59.999999 seconds' preceding and current row) as same from events")
def w10_equal_value_count(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return win.equal_value_count(t, ["user_id"], "ts", 14 * DAY, "event_type", "same").select("event_id", "same")


@query("""with days as (select cast(ts as date) as day, sum(value) as v, count(*) as n from events group by 1)
select cast(day as varchar) as day, round(sum(v) over w / sum(n) over w, 6) as mean from days window w as (order by day range between interval 6 days preceding and current row)""")
def w11_global_trailing(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    near = days.select((F.explode(F.sequence("day", F.date_add("day", 6)))).alias("day"), "v", "n")  # each day reaches seven days
    return near.join(days.select("day"), "day").groupBy("day").agg((F.sum("v") / F.sum("n")).alias("m")).select(F.col("day").cast("string").alias("day"), rounded("m", 6).alias("mean"))


@query("""with t as (select event_id, value, row_number() over w as n, avg(value) over (partition by user_id order by ts, event_id rows between 6 preceding and current row) as m from events window w as (partition by user_id order by ts, event_id))
select event_id, round(case when n >= 7 then m else (select avg(value) from events) end, 6) as m from t""")
def w12_moving_average(spark: SparkSession, d: str) -> DataFrame:
    t = tabular.with_scalars(read(spark, d, "events").select("event_id", "user_id", "ts", "value"), g=F.avg("value"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-6, 0)
    return t.select("event_id", rounded(F.coalesce(win.at_least(F.avg("value"), w, "event_id", 7), "g"), 6).alias("m"))


@query("with t as (select user_id, value, (row_number() over (partition by user_id order by ts, event_id) - 1) % 7 as band from events) select user_id, band, round(median(value), 6) as m from t group by all")
def w13_every_seventh(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = read(spark, d, "events").select("user_id", "value", F.pmod(F.row_number().over(w).cast("long") - 1, F.lit(7)).alias("band"))
    return t.groupBy("user_id", "band").agg(rounded(F.median("value"), 6).alias("m"))


@query("""with t as (select o_custkey, count(*) as n from orders group by 1), r as (select o_custkey, n, sum(n) over (order by n desc, o_custkey rows unbounded preceding) as up from t)
select o_custkey, n, cast(up as bigint) as up, round(up / (select count(*) from orders), 6) as share from r""")
def w14_running_share(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    r = ordering.running(t, "n", {"up": F.col("n")}, ["o_custkey"], descending=True)
    r = r.crossJoin(F.broadcast(t.agg(F.sum("n").alias("all"))))  # one row
    return r.select("o_custkey", "n", "up", rounded(F.col("up") / F.col("all"), 6).alias("share"))


@query("""with t as (select o_custkey, count(*) as n from orders group by 1), r as (select n, row_number() over (order by n desc, o_custkey) as i, sum(n) over (order by n desc, o_custkey rows unbounded preceding) as up, count(*) over () as k, sum(n) over () as a from t)
select round(up / a, 6) as share from r where i = cast(floor(k * 0.2) as bigint) + 1""")
def w15_share_of_top_keys(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    r = ordering.running(t, "n", {"up": F.col("n")}, ["o_custkey"], descending=True)
    r = r.crossJoin(F.broadcast(t.agg(F.sum("n").alias("a"), F.count("*").alias("k"))))  # one row
    return r.where(F.col("__row") == F.floor(F.col("k") * 0.2) + 1).select(rounded(F.col("up") / F.col("a"), 6).alias("share"))


@query("""with t as (select p_brand, count(*) as n from part group by 1), r as (select p_brand, sum(n) over (order by n desc, p_brand rows unbounded preceding) / (select count(*) from part) as up from t)
select p_partkey, (up > 0.85)::int as rare from part join r using (p_brand)""")
def w16_rare_flag(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_brand")
    t = part.groupBy("p_brand").agg(F.count("*").alias("n"))
    r = ordering.running(t, "n", {"up": F.col("n")}, ["p_brand"], descending=True).crossJoin(F.broadcast(t.agg(F.sum("n").alias("a"))))  # one row
    return part.join(r.select("p_brand", (F.col("up") / F.col("a") > 0.85).cast("int").alias("rare")), "p_brand").select("p_partkey", "rare")


@query("select p_partkey, cast(rank() over (order by p_size) + count(*) over (partition by p_size) - 1 as bigint) as upper, round(rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0, 1) as middle from part")
def w17_global_ranks(spark: SparkSession, d: str) -> DataFrame:
    t = ordering.average_rank(read(spark, d, "part").select("p_partkey", "p_size"), "p_size", "r")
    return t.select("p_partkey", F.col("r_max").alias("upper"), rounded("r", 1).alias("middle"))


@query("select o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc) as r from orders")
def w18_rank_in_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return read(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"))


@query("with m as (select p_brand, avg(p_retailprice) as m from part group by 1) select p_partkey, cast(dense_rank() over (order by round(m, 6)) - 1 as bigint) as label from part join m using (p_brand)")
def w21_target_order(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    m = part.groupBy("p_brand").agg(rounded(F.avg("p_retailprice"), 6).alias("m"))
    levels = ordering.running(m.select("m").distinct(), "m", {}).select("m", (F.col("__row") - 1).alias("label"))
    return part.join(m.join(levels, "m"), "p_brand").select("p_partkey", "label")


@query("""with t as (select user_id, row_number() over w - 1 as start, list(event_id) over (partition by user_id order by ts, event_id rows between current row and 3 following) as items from events window w as (partition by user_id order by ts, event_id))
select user_id, cast(start as int) as start, array_to_string(list_concat(items, list_transform(range(4 - len(items)), lambda x: -1)), ',') as items from t where start % 2 = 0""")
def w22_sequence_windows(spark: SparkSession, d: str) -> DataFrame:
    t = win.sequences(read(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_id", 4, 2, -1)
    return t.select("user_id", "start", F.array_join("items", ",").alias("items"))


@query("select event_id, lead(event_id) over w as next_id, lead(event_id) over w is not null as has_next, round(value - lag(value) over w, 6) as diff from events window w as (partition by user_id order by ts, event_id)")
def w24_neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ahead = F.lead("event_id").over(w)
    return read(spark, d, "events").select("event_id", ahead.alias("next_id"), ahead.isNotNull().alias("has_next"), rounded(F.col("value") - F.lag("value").over(w), 6).alias("diff"))


@query("""with t as (select doc_id, n_chars, (row_number() over (order by n_chars, doc_id) - 1) // 32 as batch from documents)
select batch, count(*) as n, max(n_chars) as longest from t group by batch having count(*) = 32""")
def w25_length_batches(spark: SparkSession, d: str) -> DataFrame:
    t = ordering.running(read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", {}, ["doc_id"])
    t = t.groupBy(F.expr("(__row - 1) div 32").alias("batch")).agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))
    return t.where("n = 32")


@query("select event_id, min(value) over w as low, max(value) over w as high, round(avg(value) over w, 6) as mean from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def a46_running_extremes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "events").select("event_id", F.min("value").over(w).alias("low"), F.max("value").over(w).alias("high"), rounded(F.avg("value").over(w), 6).alias("mean"))


@query("""select o.o_orderkey, (select p.s from (select o_custkey, o_orderdate, o_orderkey, (o_orderkey % 5)::bigint as s from orders) p where p.o_custkey = o.o_custkey and (p.o_orderdate, p.o_orderkey) <= (o.o_orderdate, o.o_orderkey)
 group by p.s order by count(*) desc, p.s limit 1) as mode from orders o""")
def a46_running_mode(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderkey") % 5).alias("s"))
    return win.running_mode(t, ["o_custkey"], ["o_orderdate", "o_orderkey"], "s", "mode").select("o_orderkey", "mode")
