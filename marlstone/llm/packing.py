"""Packing by optimal length buckets.

One aggregation gives the global histogram of token counts (its size is the
number of distinct counts, bounded by the longest document). Dynamic
programming over it chooses the bucket boundaries that minimise padding; each
document is padded to the boundary of its bucket, so ``budget // boundary``
documents fill a batch. Batches form inside (bucket, shard): shards hold about
``SHARD_ROWS`` rows by a hash of id, text and part of the input, whatever the
size of the table, so no task ever sorts a whole bucket, and null or repeated
ids, even whole repeated rows, are spread over the shards.

Defined results: a null text has no tokens and goes to the bucket of its
length; a document longer than the budget is a batch of its own, whole; ties
and repeated rows are kept and ordered by id and length; an empty table gives
an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlstone.llm.common import text_of

BUCKETS = 12
BUDGET = 16384
SHARD_ROWS = 2000
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


def token_count(text: str) -> Column:
    """Tokens of a text: runs of letters, runs of digits, and other signs one by one."""
    return F.regexp_count(text_of(text), F.lit(TOKEN))


def best_boundaries(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with least total padding.

    With lengths v_1 < ... < v_n, counts c, prefix sums C of c and S of c*v, a
    bucket (i, j] pads v_j * (C_j - C_i) - (S_j - S_i). For each number of
    buckets the best i for every j is the lower envelope of the lines
    -C_i * x + (cost_i + S_i) at x = v_j, which is linear since slopes fall and
    the v_j rise.
    """
    pairs = sorted((int(v), int(c)) for v, c in histogram if c)
    n = len(pairs)
    if not n:
        return []
    total, weight = [0], [0]
    for v, c in pairs:
        total.append(total[-1] + c)
        weight.append(weight[-1] + c * v)
    cost = [pairs[j - 1][0] * total[j] - weight[j] if j else 0 for j in range(n + 1)]
    came = []
    for k in range(2, min(buckets, n) + 1):
        hull: list[int] = []
        head, fresh, back = 0, [0] * (n + 1), [0] * (n + 1)
        height = [cost[i] + weight[i] for i in range(n + 1)]

        def useless(a: int, b: int, c: int, height: list[int] = height) -> bool:
            return (height[c] - height[a]) * (total[b] - total[a]) <= (height[b] - height[a]) * (total[c] - total[a])

        for j in range(k, n + 1):
            i = j - 1
            while len(hull) - head >= 2 and useless(hull[-2], hull[-1], i):
                hull.pop()
            hull.append(i)
            x = pairs[j - 1][0]
            while len(hull) - head >= 2 and height[hull[head + 1]] - total[hull[head + 1]] * x <= height[hull[head]] - total[hull[head]] * x:
                head += 1
            i = hull[head]
            fresh[j], back[j] = x * (total[j] - total[i]) - (weight[j] - weight[i]) + cost[i], i
        came.append(back)
        cost = [*cost[:k], *fresh[k:]]
        cost[:k] = [10**30] * k
    out, j = [], n
    for back in reversed(came):
        out.append(pairs[j - 1][0])
        j = back[j]
    out.append(pairs[j - 1][0])
    return out[::-1]


def pack(docs: DataFrame, key: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each document: key, n_tokens, bucket (its boundary), shard, batch, slot, padding.

    A batch is (bucket, shard, batch); the sum of its padded lengths is within
    ``budget`` unless it is one single longer document.
    """
    spread = F.xxhash64(F.col(f"`{key}`"), F.col("`text`") if length is None else length, F.spark_partition_id())
    sized = docs.select(F.col(f"`{key}`").alias(key), (token_count("text") if length is None else length).cast("long").alias("n_tokens"), spread.alias("__spread"))
    histogram = [(r[0], r[1]) for r in sized.groupBy("n_tokens").agg(F.count("*")).collect()]
    spark = docs.sparkSession
    edges = best_boundaries(histogram, buckets)
    if not edges:
        return sized.drop("__spread").select("*", *[F.lit(None).cast("long").alias(c) for c in ("bucket", "shard", "batch", "slot", "padding")])
    rows = dict.fromkeys(edges, 0)
    for v, c in histogram:
        rows[next(e for e in edges if v <= e)] += c
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "shards", "fits")])
    plan = spark.createDataFrame([(e, -(-rows[e] // shard_rows), max(1, budget // max(1, e))) for e in edges], kind)
    chosen = F.lit(edges[-1]).cast("long")
    for e in reversed(edges[:-1]):
        chosen = F.when(F.col("n_tokens") <= e, F.lit(e).cast("long")).otherwise(chosen)
    placed = sized.withColumn("bucket", chosen).join(F.broadcast(plan), "bucket")  # at most BUCKETS rows
    placed = placed.withColumn("shard", F.pmod("__spread", F.col("shards")))
    order = Window.partitionBy("bucket", "shard").orderBy(key, "n_tokens")
    numbered = placed.withColumn("__n", F.row_number().over(order).cast("long") - 1)
    return numbered.select(key, "n_tokens", "bucket", "shard", F.expr("__n div fits").alias("batch"), F.expr("__n % fits").alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))
