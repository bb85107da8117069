"""Writers: delimited files, submission frames and text exports for other tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.encoders import dense_ids


def csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def submission(df: DataFrame, key: str, prediction: str) -> DataFrame:
    """Two columns: id and prediction."""
    return df.select(F.col(key).alias("id"), F.col(prediction).alias("prediction"))


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def libffm_lines(df: DataFrame, key: str, label: str, fields: Sequence[str]) -> DataFrame:
    """key, value: ``label field:id:1 ...`` with one dictionary of (field, value) over all rows, numbered in sorted order."""
    long = df.select(key, label, F.posexplode(F.array(*[F.concat(F.lit(f"{f}_____"), F.coalesce(F.col(f).cast("string"), F.lit("nan"))) for f in fields])).alias("field", "pair"))
    ids = dense_ids(long.select("pair").distinct(), "pair", "id")
    cells = long.join(ids, "pair").select(key, label, F.struct("field", F.concat_ws(":", F.col("field"), F.col("id") + 1, F.lit(1)).alias("cell")).alias("c"))
    lines = cells.groupBy(key, label).agg(F.array_sort(F.collect_list("c")).alias("cells"))  # as many cells as fields
    return lines.select(key, F.concat_ws(" ", F.col(label).cast("string"), F.array_join(F.transform("cells", lambda c: c["cell"]), " ")).alias("value"))


def vw_lines(label: str, numbers: Sequence[str], categories: Sequence[str], weight: Column | None = None) -> Column:
    """``label weight |num a:1 |cat b_x``; colons, bars and blanks are taken out of values, nulls are left out."""
    tidy = lambda c: F.translate(F.col(c).cast("string"), ":| \t\n", "")
    num = F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in numbers])
    cat = F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}_"), tidy(c))) for c in categories])
    sign = F.when(F.col(label) > 0, "1").otherwise("-1")
    return F.concat(sign, F.lit(" "), F.coalesce(weight.cast("string") if weight is not None else F.lit(None), F.lit("1.0")), F.lit(" |num "), num, F.lit(" |cat "), cat)


def feature_map(df: DataFrame) -> DataFrame:
    """``position name q`` for every column: a few lines, made from the schema."""
    return df.sparkSession.createDataFrame([(k, f"{k}\t{c}\tq") for k, c in enumerate(df.columns)], "position int, value string")


def text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
