"""Queries for the remaining rows of each family: small variants beside the main ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import dates
from marlstone.functions import numeric as num
from marlstone.functions import text as tx
from marlstone.functions.numeric import rounded
from marlstone.operators import aggregates as agg
from marlstone.operators import encoders as enc
from marlstone.operators import folds, joins, ordering, tabular, userfuncs
from marlstone.operators import vocabulary as voc
from marlstone.operators.joins import attach
from marlstone.plans.projections import _NULLED, nulled
from marlstone.plans.registry import query
from marlstone.sources.tables import read

@query("select p_partkey, case when contains(p_type, 'PROMO') then 'promo' when contains(p_type, 'STANDARD') then 'plain' when starts_with(p_type, 'E') then 'e' else 'rest' end as family from part")
def p15_substring_branches(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("p_type")
    return read(spark, d, "part").select("p_partkey", tabular.first_match([(t.contains("PROMO"), F.lit("promo")), (t.contains("STANDARD"), F.lit("plain")), (t.startswith("E"), F.lit("e"))], F.lit("rest")).alias("family"))


@query("select c_custkey, c_nationkey in (select s_nationkey from supplier where s_suppkey <= 5) as near from customer")
def p17_membership_flag(spark: SparkSession, d: str) -> DataFrame:
    keys = read(spark, d, "supplier").where("s_suppkey <= 5").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("hit", F.lit(True))
    return read(spark, d, "customer").join(keys, "c_nationkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("near"))


@query("select o_orderkey, least(o_totalprice, 100000.0) as capped from orders")
def p36_upper_cap(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.least("o_totalprice", F.lit(100000.0)).alias("capped"))


@query("with k as (select p_type, dense_rank() over (order by p_type) - 1 as code from (select distinct p_type from part where p_partkey % 2 = 0)) select p_partkey, cast(coalesce(code, -1) as bigint) as code from part left join k using (p_type)")
def p42_align_categories(spark: SparkSession, d: str) -> DataFrame:
    return enc.train_ids(read(spark, d, "part").select("p_partkey", "p_type"), "p_type", F.col("p_partkey") % 2 == 0, "code").select("p_partkey", "code")


@query(f"select o_orderkey, coalesce(s, 'unk') as s, coalesce(cast(k as varchar), 'None') as k from ({_NULLED})")
def p46_null_sentinels(spark: SparkSession, d: str) -> DataFrame:
    return nulled(spark, d).select("o_orderkey", F.coalesce("s", F.lit("unk")).alias("s"), F.coalesce(F.col("k").cast("string"), F.lit("None")).alias("k"))


@query("select o_orderkey, (o_totalprice > 1000)::int as flag from orders")
def p47_flags(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 1000).cast("int").alias("flag"))


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def j05_other_key_names(spark: SparkSession, d: str) -> DataFrame:
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).drop("r_regionkey").select("n_name", "r_name")


@query("with a as (select c_custkey, row_number() over (order by c_custkey) as i from customer), b as (select o_custkey, row_number() over (order by o_custkey) as i from (select distinct o_custkey from orders)) select c_custkey, o_custkey from a join b using (i)")
def j09_positional_bind(spark: SparkSession, d: str) -> DataFrame:
    a = ordering.running(read(spark, d, "customer").select("c_custkey"), "c_custkey", {})
    b = ordering.running(read(spark, d, "orders").select("o_custkey").distinct(), "o_custkey", {})
    return a.join(b, "__row").select("c_custkey", "o_custkey")


@query("with t as (select distinct p_size as lo, p_size + p_partkey % 5 as hi from part where p_partkey < 100) select a.p_partkey from part a join t on a.p_size = t.lo and a.p_size + a.p_partkey % 5 = t.hi")
def j16_exact_interval(spark: SparkSession, d: str) -> DataFrame:
    spans = read(spark, d, "part").select("p_partkey", F.col("p_size").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 5).alias("hi"))
    return spans.join(spans.where("p_partkey < 100").select("lo", "hi").distinct(), ["lo", "hi"]).select("p_partkey")


@query("select c_custkey, coalesce(n_name, 'missing') as n_name from customer left join (select * from nation where n_nationkey % 3 > 0) on c_nationkey = n_nationkey")
def j19_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup(read(spark, d, "customer"), table, "c_nationkey", "n_name", "missing").select("c_custkey", "n_name")


@query("select l_suppkey, count(distinct l_partkey) as parts, min(l_quantity) as low, max(l_quantity) as high from lineitem group by 1")
def a03_distinct_min_max(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("select p_brand, round(avg(p_size), 4) as p_size_mean, round(stddev_samp(p_size), 4) as p_size_std, round(avg(p_retailprice), 4) as p_retailprice_mean, round(stddev_samp(p_retailprice), 4) as p_retailprice_std from part group by 1")
def a13_all_numeric(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select("p_brand", "p_size", "p_retailprice")
    numeric = [c for c, kind in t.dtypes if kind in ("int", "bigint", "double")]
    return agg.aggregate(t, ["p_brand"], {c: ["mean", "std"] for c in numeric}, 4)


@query("select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as keys from orders group by 1")
def a14_collect(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("keys"))


@query("select count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as low, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2, quantile_cont(value, 0.75) as q3, max(value) as high from events")
def a18_describe_all(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events")
    plain = t.agg(F.count("value").alias("n"), rounded(F.avg("value"), 6).alias("mean"), rounded(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    return plain.crossJoin(F.broadcast(ordering.percentiles(t, "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})))  # one row


@query("select cast(floor(value / 10) as bigint) as bin, count(*) as n from events group by 1")
def a38_histogram(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))


@query("select 'l_tax' as c, round(abs(corr(l_tax, l_extendedprice)), 6) as r from lineitem union all select 'l_discount', round(abs(corr(l_discount, l_extendedprice)), 6) from lineitem union all select 'l_quantity', round(abs(corr(l_quantity, l_extendedprice)), 6) from lineitem")
def a41_correlation_with_one(spark: SparkSession, d: str) -> DataFrame:
    names = ["l_tax", "l_discount", "l_quantity"]
    one = read(spark, d, "lineitem").agg(*[rounded(F.abs(F.corr(c, "l_extendedprice")), 6).alias(c) for c in names])
    return one.unpivot([], names, "c", "r")


@query("select event_id, round(value - median(value) over (partition by event_type), 6) as off from events")
def w04_off_median(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", "event_type", "value")
    t = attach(t, ordering.group_percentiles(t, ["event_type"], "value", {"m": 0.5}), ["event_type"])
    return t.select("event_id", rounded(F.col("value") - F.col("m"), 6).alias("off"))


@query("with f as (select p_brand, row_number() over (order by min(p_partkey)) - 1 as i from part group by 1) select p_partkey, cast(i as bigint) as i from part join f using (p_brand)")
def w20_first_appearance(spark: SparkSession, d: str) -> DataFrame:
    return enc.first_appearance(read(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"], "i").select("p_partkey", "i")


@query("with v as (select c_nationkey as k from customer union select s_nationkey from supplier), i as (select k, dense_rank() over (order by k) - 1 as code from v) select s_suppkey, cast(code as bigint) as code from supplier join i on s_nationkey = k")
def e08_shared_labels(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    both = read(spark, d, "customer").select(F.lit(None).cast("long").alias("s_suppkey"), F.col("c_nationkey").alias("k")).unionByName(s)
    return enc.dense_ids(both, "k", "code").where("s_suppkey is not null").select("s_suppkey", "code")


@query("select o_orderkey, (o_orderstatus = 'O')::int as o_orderstatus_O, (o_orderstatus = 'P')::int as o_orderstatus_P from orders")
def e11_drop_first(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", *enc.one_hot("o_orderstatus", ["F", "O", "P"], drop_first=True))


@query("with m as (select o_custkey, avg(o_totalprice) as m from orders group by 1) select o_orderkey, round(m, 4) as m from orders join m using (o_custkey)")
def e16_group_mean(spark: SparkSession, d: str) -> DataFrame:
    t = agg.join_back(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], F.avg("o_totalprice").alias("m"))
    return t.select("o_orderkey", rounded("m", 4).alias("m"))


@query("select o_orderkey, case when o_orderstatus = 'F' then round(-2.0 / 3, 6) else round(1.0 / 3, 6) end as c1, case when o_orderstatus = 'P' then round(2.0 / 3, 6) else round(-1.0 / 3, 6) end as c2 from orders")
def e24_backward_difference(spark: SparkSession, d: str) -> DataFrame:
    """Contrast of level j against the levels before it, for the levels F, O, P: (-(k - j) / k up to j, j / k beyond)."""
    levels, s = ["F", "O", "P"], F.col("o_orderstatus")
    k = len(levels)
    made = [F.when(s.isin(levels[:j]), rounded(F.lit(-(k - j) / k), 6)).otherwise(rounded(F.lit(j / k), 6)).alias(f"c{j}") for j in range(1, k)]
    return read(spark, d, "orders").select("o_orderkey", *made)


@query("select l_suppkey, round(avg(l_discount), 6) as importance from lineitem group by 1 order by importance desc, l_suppkey limit 5")
def o07_top_means(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem").groupBy("l_suppkey").agg(rounded(F.avg("l_discount"), 6).alias("importance"))
    return ordering.top_k(t, 5, F.desc("importance"), F.col("l_suppkey"))


@query("(select event_id, 'low' as side from events order by value, event_id limit 4) union all (select event_id, 'high' from events order by value desc, event_id limit 4)")
def o08_extremes(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").select("event_id", "value")
    low = ordering.top_k(t, 4, F.col("value"), F.col("event_id")).select("event_id", F.lit("low").alias("side"))
    return low.union(ordering.top_k(t, 4, F.desc("value"), F.col("event_id")).select("event_id", F.lit("high")))


@query("select 'only_orders' as side, 'o_orderkey' as c union all select 'only_orders', 'o_orderstatus' union all select 'only_customers', 'c_name'")
def u05_column_difference(spark: SparkSession, d: str) -> DataFrame:
    a = set(read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("key")).columns)
    b = set(read(spark, d, "customer").select("c_name", F.col("c_custkey").alias("key")).columns)
    rows = [("only_orders", c) for c in sorted(a - b)] + [("only_customers", c) for c in sorted(b - a)]
    return spark.createDataFrame(rows, "side string, c string")


_HASH = "cast(('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8)) as bigint)"


@query(f"select o_orderkey from orders where not ({_HASH} % 10 = 3)")
def u06_without_holdout(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey")
    out = o.where(folds.fold_of("o_orderkey", 10) == 3)
    return o.join(out, "o_orderkey", "left_anti")


_SAID = "select doc_id, text as x from documents"


def said(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.col("text").alias("x"))


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


# Words and signs of the tables' texts that stand for reserved words, emoji, abbreviations and moods.
RESERVED = ("the", "la", "der")
SIGNS = (("***", "EMO_POS"), ("%%%", "EMO_NEG"), ("###", "EMO_POS"))
SHORT = (("th", "this here"), ("la", "over there"), ("sch", "be quick"))
GOOD, BAD, NOT = ("the", "and", "que"), ("of", "la", "der"), ("in", "de")
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåçèéêëìíîïñòóôõöùúûüýÿß"


@query(f"select doc_id, md5(regexp_replace(x, '(the|la|der)', ' ', 'g')) as a, md5(translate(x, '!\"#$%&' || chr(39) || '()*+,-./:;<=>?@[\\]^_`{{|}}~', '')) as b from ({_SAID})")
def t22_reserved_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return said(spark, d).select("doc_id", _md5(F.regexp_replace("x", f"({'|'.join(RESERVED)})", " ")).alias("a"), _md5(F.translate("x", tx.PUNCTUATION, "")).alias("b"))


@query(f"select doc_id, md5(trim(regexp_replace(regexp_replace(x, '([^\\pL\\pN\\s])', ' \\1 ', 'g'), '\\s+', ' ', 'g'))) as x from ({_SAID})")
def t24_isolate_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return said(spark, d).select("doc_id", _md5(tx.isolate_punctuation("x")).alias("x"))


@query(f"select doc_id, md5(replace(replace(replace(x, '***', 'EMO_POS'), '%%%', 'EMO_NEG'), '###', 'EMO_POS')) as x from ({_SAID})")
def t31_emoji_tags(spark: SparkSession, d: str) -> DataFrame:
    """Any table of signs and tags, in its order."""
    return said(spark, d).select("doc_id", _md5(tx.rewrite("x", SIGNS)).alias("x"))


@query(f"select doc_id, md5(replace(replace(x, '$$$', 'money_face'), '!', 'loud_face')) as x from ({_SAID})")
def t32_emoticon_names(spark: SparkSession, d: str) -> DataFrame:
    return said(spark, d).select("doc_id", _md5(tx.rewrite("x", (("$$$", "money_face"), ("!", "loud_face")))).alias("x"))


@query(f"select doc_id, md5(array_to_string(list_transform(string_split(x, ' '), lambda w: case lower(w) when 'th' then 'this here' when 'la' then 'over there' when 'sch' then 'be quick' else w end), ' ')) as x from ({_SAID})")
def t34_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    full = F.create_map(*[F.lit(v) for kv in SHORT for v in kv])
    return said(spark, d).select("doc_id", _md5(F.array_join(F.transform(F.split("x", " "), lambda w: F.coalesce(F.try_element_at(full, F.lower(w)), w)), " ")).alias("x"))


def _squeezed(x: str) -> str:
    for c in LETTERS + LETTERS.upper().replace("SS", ""):
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}{c}', 'g')"
    return x


@query(f"select doc_id, md5({_squeezed('x')}) as x from ({_SAID})")
def t35_squeeze_letters(spark: SparkSession, d: str) -> DataFrame:
    return said(spark, d).select("doc_id", _md5(tx.squeeze_letters("x")).alias("x"))


@query(f"select doc_id, md5(array_to_string(list_transform(string_split(x, ' '), lambda w: regexp_replace(w, '^[''\"(]', '')), ' ')) as x from ({_SAID})")
def t40_leading_quotes(spark: SparkSession, d: str) -> DataFrame:
    return said(spark, d).select("doc_id", _md5(F.array_join(F.transform(F.split("x", " "), lambda w: F.regexp_replace(w, "^['\"(]", "")), " ")).alias("x"))


@query("select n_name, cast(levenshtein(n_name, r_name) as int) as distance, round(length(replace(n_name, 'A', '')) / length(n_name), 6) as ratio from nation join region on n_regionkey = r_regionkey")
def t41_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    plain = F.length(F.replace("n_name", F.lit("A"), F.lit("")))
    return t.select("n_name", F.levenshtein("n_name", "r_name").alias("distance"), rounded(plain / F.length("n_name"), 6).alias("ratio"))


@query(f"""with w as (select doc_id, list_filter(string_split_regex(lower(x), '[ \\t\\n\\x0B\\f\\r]+'), lambda v: v <> '') as w from ({_SAID})), m as (select doc_id, list_transform(range(1, len(w) + 1), lambda i: case when w[i] in ('the', 'and', 'que') then 1 when w[i] in ('of', 'la', 'der') then -1 else 0 end * case when i > 1 and w[i - 1] in ('in', 'de') then -1 else 1 end) as s from w)
select doc_id, cast(len(list_filter(s, lambda v: v > 0)) as int) as positive, cast(len(list_filter(s, lambda v: v < 0)) as int) as negative from m""")
def t43_negated_sentiment(spark: SparkSession, d: str) -> DataFrame:
    w = tx.negated(F.lower("x"), NOT)
    good, bad = [*GOOD, *[f"not_{v}" for v in BAD]], [*BAD, *[f"not_{v}" for v in GOOD]]
    return said(spark, d).select("doc_id", F.size(F.filter(w, lambda v: v.isin(*good))).alias("positive"), F.size(F.filter(w, lambda v: v.isin(*bad))).alias("negative"))


@query("select doc_id, cast(case when n_chars <= 500 then 500 when n_chars <= 2000 then 2000 when n_chars <= 8000 then 8000 else 32000 end as int) as padded from documents")
def t52_padding_length(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return read(spark, d, "documents").select("doc_id", F.when(n <= 500, 500).when(n <= 2000, 2000).when(n <= 8000, 8000).otherwise(32000).alias("padded"))


@query("select page_id, regexp_extract(url, '([a-z]+)\\.example', 1) as key, regexp_extract(url, '\\.([a-z]+)(?:/|$)', 1) as suffix from pages".replace("\\\\", "\\"))
def t57_extract_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"([a-z]+)\.example", 1).alias("key"), F.regexp_extract("url", r"\.([a-z]+)(?:/|$)", 1).alias("suffix"))


@query("select p_partkey, p_name || '/' || p_brand as rope, substr(p_name || '/' || p_brand, 3, 5) as part, substr(p_name, 2, 1) as sign from part")
def t58_rope(spark: SparkSession, d: str) -> DataFrame:
    rope = F.concat("p_name", F.lit("/"), "p_brand")
    return read(spark, d, "part").select("p_partkey", rope.alias("rope"), F.substring(rope, 3, 5).alias("part"), F.substring("p_name", 2, 1).alias("sign"))


@query("select event_id, cast(cast(ts as date) as varchar) as day, isodow(ts) >= 6 as weekend from events where isodow(ts) in (1, 6, 7)")
def y11_weekend(spark: SparkSession, d: str) -> DataFrame:
    w = F.weekday("ts")
    return read(spark, d, "events").where(w.isin(0, 5, 6)).select("event_id", F.to_date("ts").cast("string").alias("day"), (w >= 5).alias("weekend"))


@query("select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(floor((dayofyear(o_orderdate) - 1) / 7) as bigint) as week from orders")
def y16_split_month(spark: SparkSession, d: str) -> DataFrame:
    ym = F.split(F.date_format("o_orderdate", "yyyy-MM"), "-")
    return read(spark, d, "orders").select("o_orderkey", ym[0].cast("int").alias("y"), ym[1].cast("int").alias("m"), F.floor((F.dayofyear("o_orderdate") - 1) / 7).alias("week"))


@query("select o_orderkey, month(o_orderdate) in (1, 4, 7, 10) and day(o_orderdate) = 1 as quarter_start, month(o_orderdate) = 1 and day(o_orderdate) = 1 as year_start from orders")
def y07_period_starts(spark: SparkSession, d: str) -> DataFrame:
    b = dates.boundaries("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", b["quarter_start"].alias("quarter_start"), b["year_start"].alias("year_start"))


@query("select p_partkey, round_even(p_retailprice / 3, 1) as half_even, round(case when p_size % 2 = 0 then p_retailprice * 0.9 else p_retailprice * 1.1 end, 6) as scaled from part")
def v03_rounding(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_retailprice")
    return read(spark, d, "part").select("p_partkey", num.half_even(p / 3, 1).alias("half_even"), rounded(F.when(F.col("p_size") % 2 == 0, p * 0.9).otherwise(p * 1.1), 6).alias("scaled"))


_NEST = "select o_custkey, list({'k': o_orderkey, 'p': o_totalprice, 's': o_orderstatus} order by o_orderkey) as a from orders group by 1"


def nested(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").groupBy("o_custkey")
    return t.agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s")))).alias("a"))


@query(f"select o_custkey, round(list_avg(list_transform(a, lambda x: x.p)), 4) as mean, list_max(list_transform(a, lambda x: x.p)) as high, cast(len(a) as int) as n, array_to_string(list_transform(a, lambda x: x.s), ' ') as names, round(list_sum(list_transform(a, lambda x: x.p)), 2) as p_sum from ({_NEST})")
def q03_nested_statistics(spark: SparkSession, d: str) -> DataFrame:
    prices = F.transform("a", lambda x: x["p"])
    return nested(spark, d).select(
        "o_custkey", rounded(num.total(prices) / F.size("a"), 4).alias("mean"), F.array_max(prices).alias("high"), F.size("a").alias("n"),
        F.array_join(F.transform("a", lambda x: x["s"]), " ").alias("names"), rounded(num.total(prices), 2).alias("p_sum"),
    )


@query(f"select o_custkey, a[1].k as first_k, a[1].p as first_p, a[3].k is not null as has_third from ({_NEST})")
def q08_flatten(spark: SparkSession, d: str) -> DataFrame:
    t = nested(spark, d).select("o_custkey", F.col("a")[0].alias("s"), F.get("a", F.lit(2))["k"].isNotNull().alias("has_third"))
    return t.select("o_custkey", F.col("s.k").alias("first_k"), F.col("s.p").alias("first_p"), "has_third")


@query("""with t as (select vec_id, list_transform(embedding[1:6], lambda x: cast(x as double)) as v from embeddings), u as (select vec_id, 0 as way, v from t union all select vec_id, 1, list_concat(v[2:], [0.0::double]) from t union all select vec_id, 2, list_concat([0.0::double], v[:5]) from t)
select vec_id, way, v[1] as a, v[6] as b from u""")
def q12_shifts(spark: SparkSession, d: str) -> DataFrame:
    v, zero = F.col("v"), F.array(F.lit(0.0))
    t = read(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")).alias("v"))
    t = t.select("vec_id", F.posexplode(F.array(v, F.concat(F.slice(v, 2, 5), zero), F.concat(zero, F.slice(v, 1, 5)))).alias("way", "v"))
    return t.select("vec_id", "way", F.col("v")[0].alias("a"), F.col("v")[5].alias("b"))


@query(f"select o_orderkey, case when ntile(10) over (partition by o_orderstatus order by {_HASH}, o_orderkey) <= 2 then 'valid' else 'train' end as part from orders")
def f03_stratified_holdout(spark: SparkSession, d: str) -> DataFrame:
    t = folds.tiles(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 10)
    return t.select("o_orderkey", F.when(F.col("tile") <= 2, "valid").otherwise("train").alias("part"))


@query("with f as (select unnest(range(4)) as fold), e as (select event_id, date_diff('day', date '2024-01-01', cast(ts as date)) as day from events) select fold, count(*) filter (day < 10 + fold * 4) as train, count(*) filter (day between 12 + fold * 4 and 15 + fold * 4) as valid from e, f group by 1".replace("select unnest(range(4)) as fold", "select cast(unnest(range(4)) as int) as fold"))
def f05_expanding_split(spark: SparkSession, d: str) -> DataFrame:
    plan = [(k, 0, 9 + 4 * k, 12 + 4 * k, 15 + 4 * k) for k in range(4)]
    t = read(spark, d, "events").select("event_id", F.datediff("ts", F.lit("2024-01-01")).alias("day"))
    return folds.in_folds(t, "day", plan).groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "valid").alias("valid"))


@query("""with g as (select user_id, row_number() over (order by round(avg(value), 6), user_id) - 1 as i from events group by 1)
select event_id, cast(i % 4 as bigint) as fold from events join g using (user_id)""")
def f08_group_folds(spark: SparkSession, d: str) -> DataFrame:
    return folds.balanced_groups(read(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "value", 4).select("event_id", "fold")


@query("""with t as (select o_orderkey, o_custkey, o_totalprice as y, cast(('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8)) as bigint) % 3 as f from orders), c as (select o_custkey, f, sum(y) as s, count(*) as n from t group by all), w as (select o_custkey, sum(s) as s, sum(n) as n from c group by 1)
select o_orderkey, f as fold, case when w.n > c.n then round((w.s - c.s) / (w.n - c.n), 3) end as oof from t join c using (o_custkey, f) join w using (o_custkey)""")
def b08_out_of_fold_predictions(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("y"), folds.fold_of("o_orderkey", 3).alias("fold"))
    c = t.groupBy("o_custkey", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    w = c.groupBy("o_custkey").agg(F.sum("s").alias("ws"), F.sum("n").alias("wn"))
    table = c.join(w, "o_custkey").select("o_custkey", "fold", F.when(F.col("wn") > F.col("n"), rounded((F.col("ws") - F.col("s")) / (F.col("wn") - F.col("n")), 3)).alias("oof"))
    return t.join(table, ["o_custkey", "fold"]).select("o_orderkey", "fold", "oof")


@query("select user_id, cast(unnest(range(cast(count(*) as bigint) // 50)) as bigint) as batch from events group by user_id")
def h05_table_function(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return userfuncs.table_function(t, ["user_id"], ["n"], lambda n: ((k,) for k in range(n // 50)), "batch long")


@query("select user_id, event_id, cast(row_number() over (partition by user_id order by value, event_id) as bigint) as place from events")
def h04_group_apply(spark: SparkSession, d: str) -> DataFrame:
    def places(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["value", "event_id"])
        return group[["user_id", "event_id"]].assign(place=range(1, len(group) + 1))

    t = read(spark, d, "events").select("user_id", "event_id", "value")
    return userfuncs.group_apply(t, ["user_id"], places, "user_id long, event_id long, place long")


@query("select doc_id, (length(lower(text)) - length(replace(lower(text), 'th', 'h'))) as th, (length(lower(text)) - length(replace(lower(text), 'er', 'e'))) as er from documents")
def t45_ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return read(spark, d, "documents").select("doc_id", tx.count_of(low, "th").cast("long").alias("th"), tx.count_of(low, "er").cast("long").alias("er"))


_TOKENS = r"select doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\pL]+'), lambda x: x <> '')) as word from documents"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return voc.tokens(read(spark, d, "documents").select("doc_id", "text"), "doc_id", F.split(F.lower("text"), r"[^\p{L}]+"))


@query(f"""with w as (select distinct word from ({_TOKENS})), v as (select n_name as name, substr(lower(n_name), 1, 2) as word, [n_nationkey, n_regionkey] as vector from nation),
e as (select word, arg_min(vector, vector[1]) as vector from v group by word) select word, cast(vector[1] as bigint) as x, cast(vector[2] as bigint) as y, vector is null as unknown from w left join e using (word)""")
def t50_embedding_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The vector of every word of the corpus, or that it is unknown; vectors here are two numbers of a nation, by its first two letters."""
    n = read(spark, d, "nation").select(F.substring(F.lower("n_name"), 1, 2).alias("word"), F.array(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")).alias("vector"))
    table = n.groupBy("word").agg(F.min_by("vector", F.col("vector")[0]).alias("vector"))
    found = voc.vectors(tokens(spark, d), table)
    return found.select("word", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"), "unknown")


@query(f"with w as ({_TOKENS}), v as (select word, count(*) as n from w group by 1) select doc_id, count(*) as kept from w join v using (word) where n between 3 and 400 group by 1")
def t53_drop_frequent_and_rare(spark: SparkSession, d: str) -> DataFrame:
    rows = tokens(spark, d)
    good = voc.vocabulary(rows, "doc_id").where("n between 3 and 400").select("word")
    return rows.join(good, "word", "left_semi").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("select p_partkey, contains(lower(p_type), 'pro') or contains(lower(p_type), 'eco') as wanted from part")
def t56_substring_family(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("p_type")
    return read(spark, d, "part").select("p_partkey", (t.contains("pro") | t.contains("eco")).alias("wanted"))


@query(f"with w as ({_TOKENS}) select word, count(*) as n from w where word in ('the', 'que', 'der', 'license') group by 1")
def t59_keyword_frequency(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).where(F.col("word").isin("the", "que", "der", "license")).groupBy("word").agg(F.count("*").alias("n"))


@query("select o_orderkey, cast(floor(dayofyear(o_orderdate) / 7.0) as bigint) as week, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.0, 6) as fraction from orders")
def y19_year_fraction(spark: SparkSession, d: str) -> DataFrame:
    day = F.dayofyear("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", F.floor(day / 7.0).alias("week"), rounded(F.year("o_orderdate") + (day - 1) / 365.0, 6).alias("fraction"))


@query("select p_partkey, round(0.5 * p_size + 0.25 * p_retailprice + 10, 4) as score, cast(round_even(ln(1 + p_retailprice), 0) as int) as bucket from part")
def v05_linear_score(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("p_size"), F.col("p_retailprice")
    return read(spark, d, "part").select("p_partkey", rounded(0.5 * s + 0.25 * p + 10, 4).alias("score"), num.half_even(F.log1p(p)).cast("int").alias("bucket"))


@query("""with e as (select user_id, event_type, list(event_id order by event_id) as a from events group by all) select user_id, cast(max(len(a)) as int) as most, cast(sum(len(a)) as bigint) as total, cast(count(*) as int) as kinds from e group by 1""")
def q04_nested_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_list("event_id").alias("a"))
    sizes = F.transform("g", F.size)
    t = t.groupBy("user_id").agg(F.collect_list("a").alias("g"))
    return t.select("user_id", F.array_max(sizes).alias("most"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("g").alias("kinds"))


@query(f"select o_custkey, round(list_sum(list_transform(a, lambda x: x.p)), 2) as sum_p, cast(list_sum(list_transform(a, lambda x: x.k)) as bigint) as sum_k, len(list_filter(a, lambda x: x.s = 'P')) > 0 as has_p from ({_NEST})")
def q06_struct_sums(spark: SparkSession, d: str) -> DataFrame:
    total = lambda f, kind: F.aggregate("a", F.lit(0).cast(kind), lambda s, x: s + x[f])
    return nested(spark, d).select("o_custkey", rounded(total("p", "double"), 2).alias("sum_p"), total("k", "long").alias("sum_k"), F.exists("a", lambda x: x["s"] == "P").alias("has_p"))


@query("select n_name as name, n_nationkey as code from nation")
def q14_inverted_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"))


@query("with e as (select n_nationkey as a, n_regionkey + 100 as b from nation), t as (select a, b from e union all select b, a from e) select a as node, string_agg(cast(b as varchar), ',' order by b) as near from t group by 1")
def q15_adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "nation").select(F.col("n_nationkey").alias("a"), (F.col("n_regionkey") + 100).alias("b"))
    both = e.union(e.select("b", "a"))
    return both.groupBy(F.col("a").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("b")), ",").alias("near"))


@query("""with s as (select epoch(min(ts)) as t0 from events), e as (select event_id, epoch(ts) - t0 as x from events, s), f(fold, a, b, c, d) as (values (0, 0, 600000, 700000, 1300000), (1, 300000, 900000, 1000000, 1600000), (2, 600000, 1200000, 1300000, 1900000))
select fold, count(*) filter (x between a and b) as train, count(*) filter (x between c and d) as valid from e, f group by 1""")
def f07_second_folds(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = tabular.with_scalars(read(spark, d, "events").select("event_id", us.alias("us")), t0=F.min("us"))
    t = t.select("event_id", ((F.col("us") - F.col("t0")) / 1e6).alias("x"))
    plan = folds.sliding(0, 2_000_000, 600_000, 100_000, 600_000, 300_000)
    return folds.in_folds(t, "x", plan).groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "valid").alias("valid"))


@query("with r as (select o_orderkey, row_number() over (order by o_orderkey) as i, count(*) over () as n from orders) select o_orderkey, case when i <= floor(n * 0.8) then 'train' else 'valid' end as part from r")
def f11_positional_split(spark: SparkSession, d: str) -> DataFrame:
    t = ordering.running(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", {})
    t = tabular.with_scalars(t, n=F.count("*"))
    return t.select("o_orderkey", F.when(F.col("__row") <= F.floor(F.col("n") * 0.8), "train").otherwise("valid").alias("part"))


@query("select quality as actual, count(*) filter (toxic = 0) as predicted_0, count(*) filter (toxic = 1) as predicted_1 from labels group by 1")
def x07_confusion_report(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "labels").groupBy(F.col("quality").alias("actual")).pivot("toxic", [0, 1]).agg(F.count(F.lit(1)))
    return t.select("actual", F.coalesce("0", F.lit(0)).alias("predicted_0"), F.coalesce("1", F.lit(0)).alias("predicted_1"))
