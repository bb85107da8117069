"""Ranking and classification metrics. Scores are grouped by value first, so ties are exact and totals are running sums over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ordering import running


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(score).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the share of (positive, negative) pairs in the right order, ties as one half."""
    t = running(_by_score(df, score, label), score, {"below": F.col("neg")})
    won = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return t.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def classification(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: accuracy, precision, recall, F1 of 0/1 columns; a share of nothing is 0."""
    a, p = F.col(actual), F.col(predicted)
    one = df.agg(F.count("*").alias("n"), F.sum(a * p).alias("tp"), F.sum(p).alias("pp"), F.sum(a).alias("ap"), F.count_if(a == p).alias("ok"))
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0))
    out = one.select(share("ok", "n").alias("accuracy"), share("tp", "pp").alias("precision"), share("tp", "ap").alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: rmse, mae and R squared."""
    e = F.col(actual) - F.col(predicted)
    one = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(actual).alias("v"))
    return one.select(F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("v"))).alias("r2"))


def log_loss(df: DataFrame, probability: Column, clip: float = 1e-15) -> DataFrame:
    """One row: mean of -ln of the probability given to the true class."""
    p = F.least(F.greatest(probability, F.lit(clip)), F.lit(1 - clip))
    return df.agg((-F.avg(F.ln(p))).alias("log_loss"))


def quadratic_kappa(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: weighted kappa with squared distances, from the table of counts."""
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("na"))
    columns = cells.groupBy("p").agg(F.sum("n").alias("np"))
    d = (F.col("a") - F.col("p")) * (F.col("a") - F.col("p"))
    seen = cells.agg(F.sum(d * F.col("n")).alias("seen"), F.sum("n").alias("total"))
    chance = rows.crossJoin(F.broadcast(columns)).agg(F.sum(d * F.col("na") * F.col("np")).alias("chance"))  # ratings: a few values
    return seen.crossJoin(F.broadcast(chance)).select((1 - F.try_divide(F.col("seen") * F.col("total"), F.col("chance"))).alias("kappa"))


def best_mcc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the threshold (score >= threshold is positive) with the largest Matthews correlation, the highest on ties."""
    t = running(_by_score(df, score, label), score, {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    totals = df.agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    t = t.crossJoin(F.broadcast(totals))  # one row
    tp, fp, p, q = (F.col(c).cast("double") for c in ("tp", "fp", "p", "q"))
    fn, tn = p - tp, q - fp
    mcc = F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * p * q * (tn + fn))), F.lit(0.0))
    best = F.max_by(F.struct(F.col(score).alias("threshold"), mcc.alias("mcc")), F.struct(F.round(mcc, 12), F.col(score)))
    return t.agg(best.alias("b")).select("b.threshold", "b.mcc")
