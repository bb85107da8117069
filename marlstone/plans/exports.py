"""Queries for the text exports and the record-wise totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import ordering
from marlstone.plans.registry import query
from marlstone.sources import writers
from marlstone.sources.tables import read


@query("select o_orderkey as id, o_totalprice as prediction from orders")
def k12_submission(spark: SparkSession, d: str) -> DataFrame:
    return writers.submission(read(spark, d, "orders"), "o_orderkey", "o_totalprice")


@query("""with t as (select p_partkey, (p_size > 25)::int as y, 'p_brand_____' || p_brand as a, 'p_type_____' || p_type as b from part), ids as (select v, dense_rank() over (order by v) as id from (select a as v from t union select b from t))
select p_partkey, y || ' 0:' || x.id || ':1 1:' || z.id || ':1' as value from t join ids x on x.v = a join ids z on z.v = b""")
def k09_libffm(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") > 25).cast("int").alias("y"))
    return writers.libffm_lines(t, "p_partkey", "y", ["p_brand", "p_type"])


@query("select p_partkey, case when p_size > 25 then '1' else '-1' end || ' 1.0 |num p_size:' || p_size || ' |cat p_brand_' || translate(p_brand, ':| ', '') || ' p_type_' || translate(p_type, ':| ', '') as value from part")
def k10_vw(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").withColumn("y", (F.col("p_size") > 25).cast("int"))
    return t.select("p_partkey", writers.vw_lines("y", ["p_size"], ["p_brand", "p_type"]).alias("value"))


@query("select 0 as position, '0' || chr(9) || 'r_regionkey' || chr(9) || 'q' as value union all select 1, '1' || chr(9) || 'r_name' || chr(9) || 'q'")
def k13_feature_map(spark: SparkSession, d: str) -> DataFrame:
    return writers.feature_map(read(spark, d, "region").select("r_regionkey", "r_name"))


@query("""select coalesce(nullif(case when event_id % 11 = 0 then '' else event_type end, ''), 'none') as kind, round(sum(value), 4) as total, count(*) as n from events group by 1 order by total desc limit 3""")
def r01_top_totals(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.functions.numeric import rounded
    from marlstone.streaming.stateful import running_totals

    t = read(spark, d, "events").select(F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type")).alias("kind"), "value")
    totals = running_totals(t, "kind", "value", "none").withColumn("total", rounded("total", 4))  # the same plan serves a stream
    return ordering.top_k(totals, 3, F.desc("total"))
