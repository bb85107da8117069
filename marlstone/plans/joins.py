"""Queries for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.numeric import rounded
from marlstone.operators import aggregates as agg
from marlstone.operators import encoders, joins, slots
from marlstone.plans.registry import query
from marlstone.sources.tables import read


@query("select o_orderkey, c_name from orders left join customer on o_custkey = c_custkey")
def j01_left(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return read(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", "c_name")


@query("""with a as (select l_orderkey, l_suppkey, count(*) as n from lineitem group by all), b as (select l_orderkey, l_suppkey, max(l_quantity) as q from lineitem where l_quantity > 40 group by all)
select l_orderkey, l_suppkey, n, q from a left join b using (l_orderkey, l_suppkey)""")
def j02_left_composite(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem")
    keys = ["l_orderkey", "l_suppkey"]
    return t.groupBy(*keys).agg(F.count("*").alias("n")).join(t.where("l_quantity > 40").groupBy(*keys).agg(F.max("l_quantity").alias("q")), keys, "left")


@query("select o_orderkey, c_mktsegment, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 150000")
def j03_inner(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_totalprice > 150000")
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_mktsegment", "n_name")


@query("""with a as (select c_nationkey as k, count(*) as customers from customer where c_nationkey < 20 group by 1), b as (select s_nationkey as k, count(*) as suppliers from supplier where s_nationkey > 3 group by 1)
select k, customers, suppliers from a full join b using (k)""")
def j07_full(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = read(spark, d, "supplier").where("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@query("""select o_custkey, round(avg(o_totalprice) filter (o_orderkey % 3 = 0), 4) as f0, round(avg(o_totalprice) filter (o_orderkey % 3 = 1), 4) as f1, round(avg(o_totalprice) filter (o_orderkey % 3 = 2), 4) as f2 from orders group by o_custkey""")
def j08_fold_tables(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").withColumn("fold", F.col("o_orderkey") % 3)
    means = [rounded(F.avg(F.when(F.col("fold") == k, F.col("o_totalprice"))), 4).alias(f"f{k}") for k in range(3)]
    return t.groupBy("o_custkey").agg(*means)


@query("select p_partkey, coalesce(case p_type when 'PROMO' then 'x' end, 'unknown') as label from part")
def j10_dictionary(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame([("PROMO", "x")], "p_type string, label string")
    return joins.lookup(read(spark, d, "part"), table, "p_type", "label", "unknown").select("p_partkey", "label")


@query("select o_orderkey, round(avg(o_totalprice) over (partition by o_custkey), 4) as mean, count(*) over (partition by o_custkey) as n from orders")
def j11_aggregate_join_back(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    joined = agg.join_back(t, ["o_custkey"], F.avg("o_totalprice").alias("mean"), F.count("*").alias("n"))
    return joined.select("o_orderkey", rounded("mean", 4).alias("mean"), "n")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def j12_semi(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def j13_anti(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey")


@query("""with t as (select p_partkey, p_brand, p_type from part), ids as (select p_brand, p_type, dense_rank() over (order by p_brand, p_type) - 1 as id from (select distinct p_brand, p_type from t))
select p_partkey, cast(id as bigint) as id from t join ids using (p_brand, p_type)""")
def j14_composite_id(spark: SparkSession, d: str) -> DataFrame:
    return encoders.tuple_ids(read(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "id").select("p_partkey", "id")


@query("""with e as (select event_id, epoch(ts) as lo, epoch(ts) + value * 60 as hi, user_id from events where event_type = 'click')
select a.event_id as x, b.event_id as y from e a join e b on a.lo <= b.hi and b.lo <= a.hi and a.event_id < b.event_id""")
def j15_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    lo = F.unix_timestamp(F.col("ts").cast("timestamp")) + F.date_format("ts", "SSSSSS").cast("double") / 1e6
    e = read(spark, d, "events").where("event_type = 'click'").select("event_id", lo.alias("lo"), (lo + F.col("value") * 60).alias("hi"))
    return joins.overlapping_pairs(e, "event_id", "lo", "hi", 3600.0)


@query("select r_name, s from region, (select distinct o_orderstatus as s from orders)")
def j17_cartesian(spark: SparkSession, d: str) -> DataFrame:
    kinds = read(spark, d, "orders").select(F.col("o_orderstatus").alias("s")).distinct()
    return read(spark, d, "region").select("r_name").crossJoin(F.broadcast(kinds))  # two value lists of a few rows


@query("""with free as (select p_partkey, p_size, row_number() over (partition by p_size order by p_partkey) as n from part) select p_size, p_partkey as first_free from free where n = 1""")
def j18_first_free_slot(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy("p_size").agg(F.min("p_partkey").alias("first_free"))


@query("""with f as (select l_orderkey as floor, max(l_linenumber) + 1 as n from lineitem group by 1), s as (select floor, unnest(range(1, n + 1)) as slot, n from f),
free as (select floor, min(slot) as first_free, count(*) as free from s anti join lineitem l on l.l_orderkey = s.floor and l.l_linenumber = s.slot group by floor)
select f.floor as l_orderkey, cast(first_free as bigint) as first_free, coalesce(free, 0) as free from f left join free using (floor)""")
def j18_free_slots(spark: SparkSession, d: str) -> DataFrame:
    """The first line number of every order that is free, of as many as one beyond its last, and how many are free."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    floors = lines.groupBy("l_orderkey").agg((F.max("l_linenumber") + 1).alias("n"))
    return slots.first_free(floors, lines, "l_orderkey", "l_linenumber", "n")


@query("""with t as (select distinct o_custkey % 10 as floor, o_orderkey as slot from orders), n as (select max(o_orderkey) as n from orders), f as (select distinct floor from t),
s as (select floor, unnest(range(1, n + 1)) as slot from f, n), free as (select * from s anti join t using (floor, slot)), g as (select *, slot - row_number() over (partition by floor order by slot) as run from free)
select floor, cast(min(slot) as bigint) as first, cast(max(slot) as bigint) as last from g group by floor, run""")
def j18_gaps(spark: SparkSession, d: str) -> DataFrame:
    """All runs of free slots on ten floors that the orders occupy."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    taken = orders.select((F.col("o_custkey") % 10).alias("floor"), F.col("o_orderkey").alias("slot"))
    floors = taken.select("floor").distinct().crossJoin(F.broadcast(orders.agg(F.max("o_orderkey").alias("n"))))  # one row
    return slots.gaps(floors, taken, "floor", "slot", "n")


@query("""select e.event_id, (select max_by(value, (ts, event_id)) from events v where v.user_id = e.user_id and v.event_type = 'view' and v.ts <= e.ts) as last_view from events e where e.event_type = 'click'""")
def j20_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return joins.as_of(clicks, views, "user_id", "ts", "last_view").select("event_id", "last_view")
