"""Queries for projections, filters, assignments, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.numeric import rounded
from marlstone.operators import ordering, tabular
from marlstone.plans.registry import query
from marlstone.sources.tables import read


@query("select o_orderkey, o_totalprice from orders")
def p01_select(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def p02_drop(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").drop("o_orderdate", "o_orderpriority", "no_such_column")


@query("select o_orderkey as id, o_totalprice as price from orders")
def p03_rename(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").withColumnsRenamed({"o_orderkey": "id", "o_totalprice": "price"})


@query("select r_regionkey as a, r_name as b from region")
def p04_rename_all(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "region").select("r_regionkey", "r_name").toDF("a", "b")


@query("select n_nationkey as x_n_nationkey, n_name as x_n_name, n_regionkey as x_n_regionkey from nation")
def p05_prefix(spark: SparkSession, d: str) -> DataFrame:
    return tabular.prefixed(read(spark, d, "nation"), "x_")


@query("select l_orderkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as charge, round(l_extendedprice / nullif(l_quantity, 0), 6) as unit from lineitem")
def p06_derive(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    charge = price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return read(spark, d, "lineitem").select("l_orderkey", rounded(charge, 6).alias("charge"), rounded(F.try_divide(price, "l_quantity"), 6).alias("unit"))


@query("select l_orderkey, l_linenumber, l_quantity * 2 as l_quantity_x2, l_tax * 2 as l_tax_x2, l_discount * 2 as l_discount_x2 from lineitem")
def p07_generated_columns(spark: SparkSession, d: str) -> DataFrame:
    made = [(F.col(c) * 2).alias(f"{c}_x2") for c in ("l_quantity", "l_tax", "l_discount")]
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *made)


@query("select o_orderkey from orders where o_totalprice > 200000 and o_orderstatus = 'F'")
def p08_mask(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where((F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("select o_orderkey from orders where o_totalprice >= 1000 and o_totalprice < 50000")
def p09_expression_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where("o_totalprice >= 1000 and o_totalprice < 50000").select("o_orderkey")


@query("""select p_partkey, case when contains(p_name, '1') then 'one' when contains(p_type, 'A') then 'a-type' when p_size is null then 'none' else 'other' end as family from part""")
def p10_rule_table(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("p_name").contains("1"), F.lit("one")), (F.col("p_type").contains("A"), F.lit("a-type")), (F.col("p_size").isNull(), F.lit("none"))]
    return read(spark, d, "part").select("p_partkey", tabular.first_match(rules, F.lit("other")).alias("family"))


@query("select p_partkey from part where p_size in (1, 5, 9)")
def p11_membership_list(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where(F.col("p_size").isin(1, 5, 9)).select("p_partkey")


@query("select c_custkey, case when c_acctbal < 0 then 0.0 else c_acctbal end as c_acctbal from customer")
def p12_masked_assignment(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"))


@query("select o_orderkey, case when o_totalprice > 300000 then 'huge' when o_totalprice > 200000 then 'large' when o_totalprice > 100000 then 'middle' else 'small' end as class from orders")
def p13_overwriting_rules(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    rules = [(price > 100000, F.lit("middle")), (price > 200000, F.lit("large")), (price > 300000, F.lit("huge"))]
    return read(spark, d, "orders").select("o_orderkey", tabular.last_match(rules, F.lit("small")).alias("class"))


@query("select o_orderkey, case when o_orderstatus = 'F' then 1 else 0 end as done from orders")
def p14_if_else(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("done"))


@query("select o_orderkey from orders where (o_orderstatus = 'O' or o_totalprice < 5000) and not o_orderpriority like '1%'")
def p16_masks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return read(spark, d, "orders").where(((c("o_orderstatus") == "O") | (c("o_totalprice") < 5000)) & ~c("o_orderpriority").startswith("1")).select("o_orderkey")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 20")
def p18_range(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").where(F.col("l_quantity").between(10, 20)).select("l_orderkey", "l_linenumber", "l_quantity")


_NULLED = "select o_orderkey, nullif(o_orderstatus, 'F') as s, case when o_totalprice > 100000 then o_totalprice end as p, nullif(o_custkey % 7, 0) as k from orders"


def nulled(spark: SparkSession, d: str) -> DataFrame:
    """Orders with nulls, which the tables themselves lack."""
    c = F.col
    return read(spark, d, "orders").select("o_orderkey", F.nullif(c("o_orderstatus"), F.lit("F")).alias("s"), F.when(c("o_totalprice") > 100000, c("o_totalprice")).alias("p"), F.nullif(c("o_custkey") % 7, F.lit(0)).alias("k"))


@query(f"select o_orderkey, s is null as s_null, p is not null as p_there from ({_NULLED})")
def p19_null_tests(spark: SparkSession, d: str) -> DataFrame:
    return nulled(spark, d).select("o_orderkey", F.col("s").isNull().alias("s_null"), F.col("p").isNotNull().alias("p_there"))


@query(f"select o_orderkey, cast((s is null)::int + (p is null)::int + (k is null)::int as int) as nulls from ({_NULLED})")
def p20_null_count(spark: SparkSession, d: str) -> DataFrame:
    return nulled(spark, d).select("o_orderkey", tabular.null_count(["s", "p", "k"]).alias("nulls"))


@query(f"select o_orderkey, coalesce(s, 'none') as s, coalesce(p, -1.0) as p, coalesce(k, -1) as k from ({_NULLED})")
def p21_constant_fill(spark: SparkSession, d: str) -> DataFrame:
    return nulled(spark, d).fillna({"s": "none", "p": -1.0, "k": -1})


@query(f"with t as ({_NULLED}) select o_orderkey, round(coalesce(p, (select median(p) from t)), 4) as p from t")
def p22_global_median_fill(spark: SparkSession, d: str) -> DataFrame:
    t = nulled(spark, d)
    t = t.crossJoin(F.broadcast(ordering.percentiles(t, "p", {"m": 0.5})))  # one row
    return t.select("o_orderkey", rounded(F.coalesce("p", "m"), 4).alias("p"))


@query(f"with t as (select *, coalesce(k, -1) as g from ({_NULLED})) select o_orderkey, round(coalesce(p, median(p) over (partition by g)), 4) as p from t")
def p23_group_median_fill(spark: SparkSession, d: str) -> DataFrame:
    t = nulled(spark, d).withColumn("g", F.coalesce("k", F.lit(-1)))
    return tabular.fill_group_median(t, "p", ["g"]).select("o_orderkey", rounded("p", 4).alias("p"))


@query(f"with t as ({_NULLED}), m as (select s from t where s is not null group by s order by count(*) desc, s limit 1) select o_orderkey, coalesce(t.s, m.s) as s from t, m")
def p24_mode_fill(spark: SparkSession, d: str) -> DataFrame:
    t = tabular.with_scalars(nulled(spark, d), m=F.mode("s", deterministic=True))
    return t.select("o_orderkey", F.coalesce("s", "m").alias("s"))


@query("""with t as (select user_id, ts, event_id, case when value > 50 then value end as v from events)
select event_id, last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as ffill,
       first_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as bfill from t""")
def p25_forward_backward_fill(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("value") > 50, F.col("value")).alias("v"))
    order = ["ts", "event_id"]
    return t.select("event_id", tabular.forward_fill("v", ["user_id"], order).alias("ffill"), tabular.forward_fill("v", ["user_id"], order, backward=True).alias("bfill"))


@query(f"select o_orderkey, k, coalesce(p, k) as p from ({_NULLED.replace('o_totalprice end as p', 'cast(o_totalprice as bigint) end as p')})")
def p26_row_fill(spark: SparkSession, d: str) -> DataFrame:
    t = nulled(spark, d).select("o_orderkey", "k", F.bround("p").cast("long").alias("p"))
    return t.select("o_orderkey", *tabular.row_forward_fill(["k", "p"]))


@query("""with t as (select event_id, user_id, event_type, case when event_id % 3 <> 0 then user_id % 10 end as v from events),
m as (select user_id, min(v) as v from t where v is not null group by user_id having min(v) = max(v) and count(*) >= 2)
select event_id, coalesce(t.v, m.v) as v from t left join m using (user_id)""")
def p27_dependency_fill(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 10).alias("v"))
    return tabular.fill_from_dependency(t, ["user_id"], "v").select("event_id", "v")


@query(f"select o_orderkey, coalesce(k, o_orderkey) as v from ({_NULLED})")
def p28_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return nulled(spark, d).select("o_orderkey", F.coalesce("k", "o_orderkey").alias("v"))


@query("select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 end as code from orders")
def p29_map_values(spark: SparkSession, d: str) -> DataFrame:
    codes = F.create_map(F.lit("F"), F.lit(1), F.lit("O"), F.lit(2))
    return read(spark, d, "orders").select("o_orderkey", F.try_element_at(codes, F.col("o_orderstatus")).alias("code"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'done' else o_orderstatus end as s from orders")
def p30_replace_values(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").replace({"F": "done"}, subset=["o_orderstatus"]).select("o_orderkey", F.col("o_orderstatus").alias("s"))


@query("select o_orderkey, case when count(*) over (partition by o_custkey) >= 12 then o_custkey end as c from orders")
def p31_mask_rare(spark: SparkSession, d: str) -> DataFrame:
    return tabular.mask_rare(read(spark, d, "orders"), "o_custkey", 12).select("o_orderkey", F.col("o_custkey").alias("c"))


@query("""select c_custkey, case when c_nationkey in (select s_nationkey from supplier where s_suppkey % 4 = 0) then 'both' else 'customers' end as seen from customer""")
def p32_seen_in(spark: SparkSession, d: str) -> DataFrame:
    other = read(spark, d, "supplier").where(F.col("s_suppkey") % 4 == 0).select(F.col("s_nationkey").alias("k")).distinct()
    joined = read(spark, d, "customer").join(other, F.col("c_nationkey") == F.col("k"), "left")
    return joined.select("c_custkey", F.when(F.col("k").isNull(), "customers").otherwise("both").alias("seen"))


@query("""with top as (select p_brand from part group by p_brand order by count(*) desc, p_brand limit 5)
select p_partkey, case when p_brand in (select p_brand from top) then p_brand else 'other' end as brand from part""")
def p33_keep_top(spark: SparkSession, d: str) -> DataFrame:
    return tabular.keep_top(read(spark, d, "part"), "p_brand", 5, "other").select("p_partkey", F.col("p_brand").alias("brand"))


@query("select o_orderkey, (o_orderpriority = '1-URGENT')::int as urgent from orders")
def p34_one_constant(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))


@query("select c_custkey, greatest(0.0, least(5000.0, c_acctbal)) as clipped, least(c_acctbal, 3000.0) as capped from customer")
def p35_clip(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", F.greatest(F.lit(0.0), F.least(F.lit(5000.0), b)).alias("clipped"), F.least(b, F.lit(3000.0)).alias("capped"))


@query("select o_orderkey from orders, (select quantile_cont(o_totalprice, 0.01) as lo, quantile_cont(o_totalprice, 0.99) as hi from orders) where o_totalprice between lo and hi")
def p37_within_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return tabular.within_percentiles(read(spark, d, "orders"), "o_totalprice", 0.01, 0.99).select("o_orderkey")


@query("select o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) as p from orders, (select quantile_cont(o_totalprice, 0.005) as lo, quantile_cont(o_totalprice, 0.995) as hi from orders)")
def p38_winsorise(spark: SparkSession, d: str) -> DataFrame:
    return tabular.winsorise(read(spark, d, "orders"), "o_totalprice", 0.005, 0.995).select("o_orderkey", rounded("o_totalprice", 4).alias("p"))


@query("select doc_id, try_cast(substr(source, 4) as int) as n, try_cast(lang as int) as bad, cast(trunc(n_chars / 7.0) as bigint) as weeks from documents")
def p39_casts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return read(spark, d, "documents").select("doc_id", F.substring("source", 4, 9).try_cast("int").alias("n"), c("lang").try_cast("int").alias("bad"), (c("n_chars") / 7.0).cast("long").alias("weeks"))


@query("select cast(max(p_size) as tinyint) as size, cast(max(p_partkey) as int) as k, 1 as dummy from part")
def p40_narrow(spark: SparkSession, d: str) -> DataFrame:
    t = tabular.narrow(read(spark, d, "part").select("p_partkey", "p_size"))
    return t.agg(F.max("p_size").cast("tinyint").alias("size"), F.max("p_partkey").cast("int").alias("k"), F.lit(1).alias("dummy"))


@query("select o_orderkey, cast(row_number() over (order by o_orderkey) - 1 as bigint) as row_id from orders")
def p41_row_id(spark: SparkSession, d: str) -> DataFrame:
    t = ordering.running(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", {})
    return t.select("o_orderkey", (F.col("__row") - 1).alias("row_id"))


@query("select o_orderkey, cast(case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '4-NOT SPECIFIED' then 3 when '5-LOW' then 4 else -1 end as int) as level from orders")
def p43_ordinal(spark: SparkSession, d: str) -> DataFrame:
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    codes = F.create_map(*[F.lit(x) for k, v in enumerate(levels) for x in (v, k)])
    return read(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(codes, F.col("o_orderpriority")), F.lit(-1)).alias("level"))


@query("""select 'price' as variable, round(avg(o_totalprice), 4) as mean from orders union all select 'customer', round(avg(o_custkey), 4) from orders""")
def p44_transpose(spark: SparkSession, d: str) -> DataFrame:
    wide = read(spark, d, "orders").agg(F.avg("o_totalprice").alias("price"), F.avg("o_custkey").alias("customer"))
    return tabular.unpivot(wide, [], ["price", "customer"], "variable", "mean").withColumn("mean", rounded("mean", 4))


@query(f"select o_orderkey, nullif(coalesce(s, 'na'), 'na') as s, coalesce(k, -1) as k, (p is not null)::int as flag from ({_NULLED})")
def p45_sentinels(spark: SparkSession, d: str) -> DataFrame:
    t = nulled(spark, d)
    return t.select("o_orderkey", F.nullif(F.coalesce("s", F.lit("na")), F.lit("na")).alias("s"), F.coalesce("k", F.lit(-1)).alias("k"), F.col("p").isNotNull().cast("int").alias("flag"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def o01_sort_limit(spark: SparkSession, d: str) -> DataFrame:
    return ordering.top_k(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("select o_orderkey from orders order by o_orderkey desc limit 7")
def o03_tail(spark: SparkSession, d: str) -> DataFrame:
    return ordering.top_k(read(spark, d, "orders").select("o_orderkey"), 7, F.desc("o_orderkey"))


@query("select p_type, count(*) as n from part group by p_type order by n desc, p_type limit 3")
def o04_top_values(spark: SparkSession, d: str) -> DataFrame:
    return ordering.top_k(read(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")), 3, F.desc("n"), F.col("p_type"))


@query("select p_brand, count(*) as n from part group by p_brand order by n, p_brand limit 4")
def o05_bottom_values(spark: SparkSession, d: str) -> DataFrame:
    return ordering.top_k(read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")), 4, F.col("n"), F.col("p_brand"))


@query("select o_custkey, round(sum(o_totalprice), 2) as total from orders group by o_custkey order by total desc, o_custkey limit 10")
def o06_top_groups_by_sum(spark: SparkSession, d: str) -> DataFrame:
    return ordering.top_k(read(spark, d, "orders").groupBy("o_custkey").agg(rounded(F.sum("o_totalprice"), 2).alias("total")), 10, F.desc("total"), F.col("o_custkey"))


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def u01_union_all(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("select count(*) as shared from (select c_nationkey from customer intersect select s_nationkey from supplier where s_suppkey % 3 = 0)")
def u03_intersection(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = read(spark, d, "supplier").where(F.col("s_suppkey") % 3 == 0).select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).agg(F.count("*").alias("shared"))


@query("""select 'left' as side, k from (select c_nationkey as k from customer except select s_nationkey from supplier where s_suppkey % 9 = 0)
union all select 'right', k from (select s_nationkey as k from supplier except select c_nationkey from customer where c_custkey % 50 = 0)""")
def u04_difference(spark: SparkSession, d: str) -> DataFrame:
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    k = lambda t, x: t.select(F.col(x).alias("k"))
    left = k(c, "c_nationkey").subtract(k(s.where(F.col("s_suppkey") % 9 == 0), "s_nationkey"))
    right = k(s, "s_nationkey").subtract(k(c.where(F.col("c_custkey") % 50 == 0), "c_nationkey"))
    return left.select(F.lit("left").alias("side"), "k").union(right.select(F.lit("right"), "k"))
