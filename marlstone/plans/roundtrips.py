"""What writers write, read back; scans in chunks; unions of unlike tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.numeric import rounded
from marlstone.plans.registry import query
from marlstone.sources import chunks, readers, unions, writers
from marlstone.sources.shared import fresh
from marlstone.sources.tables import read, spread


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def k01_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    t, path = read(spark, d, "orders"), fresh(spark, "csv")
    writers.csv(t, path)
    return readers.csv(spark, path, t.schema)


@query("select c_custkey, c_name, c_acctbal from customer")
def k02_gzip_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Of a compressed file three columns are parsed."""
    t, path = read(spark, d, "customer"), fresh(spark, "csv")
    writers.csv(t, path, "gzip")
    return readers.csv(spark, path, t.schema, ["c_custkey", "c_name", "c_acctbal"])


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by all")
def k07_json_report(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "report")
    t = read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))
    writers.report(t, path)
    return spark.read.schema(t.schema).json(path)


@query("select p_partkey, p_name, p_brand, p_size, p_retailprice from part")
def s01_inferred_csv(spark: SparkSession, d: str) -> DataFrame:
    """Types found from the file; identifiers are widened to those of the table."""
    path = fresh(spark, "csv")
    writers.csv(read(spark, d, "part"), path)
    t = readers.csv_inferred(spark, path, ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"])
    return t.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("select cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_nationkey as varchar) as s_nationkey from supplier")
def k08_text_columns(spark: SparkSession, d: str) -> DataFrame:
    """Written row by row, read as text columns."""
    path = fresh(spark, "csv")
    writers.csv(read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return readers.text_table(spark, path)


@query("select l_returnflag, sum(l_quantity) as quantity, count(*) as n from lineitem group by 1")
def s05_chunked_scan(spark: SparkSession, d: str) -> DataFrame:
    """Totals of every chunk of the table, a file at a time, then totals of these."""
    t = read(spark, d, "lineitem")
    total = lambda x, q, n: x.groupBy("l_returnflag").agg(F.sum(q).alias("quantity"), n.alias("n"))
    parts = chunks.process_in_chunks(spark, f"{d}/lineitem.parquet", t.schema, lambda c, _: total(c, "l_quantity", F.count("*")), fresh(spark, "chunks"), fresh(spark, "progress"), files=1)
    return total(parts, "quantity", F.sum("n"))


@query("""select c_custkey as key, c_name as name, c_nationkey as nation, c_acctbal as balance, c_mktsegment as segment, null as size from customer union all
select s_suppkey, s_name, s_nationkey, s_acctbal, null, null from supplier union all select p_partkey, p_name, null, p_retailprice, null, p_size from part union all
select r_regionkey, r_name, null, null, null, null from region""")
def u02_union_of_unlike(spark: SparkSession, d: str) -> DataFrame:
    """Four tables with other columns, orders of columns and widths of the key."""
    named = (
        ("customer", {"c_custkey": "key", "c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment"}),
        ("supplier", {"s_acctbal": "balance", "s_suppkey": "key", "s_nationkey": "nation", "s_name": "name"}),
        ("part", {"p_size": "size", "p_partkey": "key", "p_name": "name", "p_retailprice": "balance"}),
        ("region", {"r_name": "name", "r_regionkey": "key"}),
    )
    return unions.union_all([read(spark, d, t).select(*[F.col(a).alias(b) for a, b in names.items()]) for t, names in named])


@query(f"select doc_id, md5(translate(text, '{tx.EXOTIC_SPACES}{tx.ZERO_WIDTH}', '{' ' * len(tx.EXOTIC_SPACES)}')) as h from documents")
def t37_plain_spaces(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(tx.plain_spaces("text").cast("binary")).alias("h"))
