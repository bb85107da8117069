"""Quality rules: base rules and robust multivariate outliers, with DataFrame functions only.

Every document gets a vector of transformed statistics. Per (language, source)
a minimum-covariance-determinant estimate of their centre and scatter is
computed by concentration steps: keep the ``SUBSET`` share of rows nearest by
Mahalanobis distance, take mean and covariance of those, repeat until the
determinant stops falling. Of three starts the one with the least determinant
is taken. Documents beyond the chi-square quantile ``CUTOFF``
are rejected. Each step is a grouped aggregation of fixed-size states (partial
before the shuffle), so one source with a third of all rows is no hot group.

Defined results: a null text has no words and fails the base rules; a null
language or source is a group of its own; repeated rows are rated alike and
count each; texts are read whole, whatever their length; an empty table gives
an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import SPACE, WORD, materialize, release, scratch, text_of

WINDOW = 5
SUBSET = 0.75
CUTOFF = 0.9999
#: A start is done when its log determinant falls by no more than this.
LEAST_FALL = 1e-3
GROUP = ("lang", "source")
#: Standard deviations whose squares are added to the variances, as in the regularized form of the estimate: statistics are no surer than this.
RIDGE = {"x1": 0.15, "x2": 0.05, "x3": 0.05, "x4": 0.05}
X = tuple(RIDGE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the array.

    Windows are compared by 64-bit hashes within one text; sorting (hash,
    position) brings equal windows together, so the work is n log n.
    """

    def covered(h: Column) -> Column:
        def twice(s: Column) -> Column:
            n = F.size(s)
            same = lambda x, k, d: F.coalesce(F.get(s, k + d)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, k: ((k > 0) & same(x, k, -1)) | ((k < n - 1) & same(x, k, 1)))

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = F.array_sort(F.transform(let(pairs, twice), lambda x: x["i"]))
        gaps = let(at, lambda p: F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1), x + WINDOW) - x, F.lit(WINDOW))))
        total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g.cast("long"))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(total)

    hashes = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def longest_repeated(lines: Column) -> Column:
    """Most words of a line that the array holds twice or more; 0 without one."""

    def most(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (k > 0) & F.coalesce(F.get(s, k - 1) == x, F.lit(False)))
        return F.array_max(F.transform(twice, lambda x: F.size(F.array_remove(F.split(x, SPACE), ""))))

    return F.when(F.size(F.array_distinct(lines)) == F.size(lines), 0).otherwise(let(F.array_sort(lines), most))


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, base statistics, base verdict and the vector x1..x4 of every row."""
    t = text_of(text)
    base = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias("__t"), F.array_remove(F.split(t, SPACE), "").alias("__w"))
    lines = F.filter(F.split(F.col("__t"), "\n", -1), lambda x: x.rlike(WORD))
    base = base.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__t", SPACE, "")).cast("long").alias("word_chars"),
        F.length("__t").alias("__chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), longest_repeated(x).alias("longest"))).alias("__lines"),
        repeat_words(F.col("__w")).alias("n_repeat_words"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return base.select(
        *[F.col(f"`{c}`") for c in keep],
        "n_words", "word_chars", "n_symbols",
        F.col("__lines.dup").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("x1"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("__chars"), F.lit(1))).alias("x2"),
        # a passage of two lines, or a line or window of words, that stands twice says nothing, however short the text
        F.sqrt(F.greatest(F.col("__lines.dup") - 2, F.lit(0)) / F.greatest(F.col("__lines.n"), F.lit(1))).alias("x3"),
        F.sqrt(F.greatest(F.col("n_repeat_words") - 2 * F.greatest(F.col("__lines.longest"), F.lit(WINDOW)), F.lit(0)) / n).alias("x4"),
    )


def chi2_quantile(share: float, dof: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, dof) < share else (low, mid)
    return low


def chi2_share(x: float, dof: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def _grouped(left: DataFrame, params: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Rows with the parameters of their group; a null key matches a null key."""
    own = params.select(*[F.col(g).alias(f"__g_{g}") for g in group], *[c for c in params.columns if c not in group])
    on = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group]
    return left.join(own, on, "left").drop(*[f"__g_{g}" for g in group])


def distance(prefix: str = "m", lower: str = "l") -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor."""
    z: list[Column] = []
    for i, x in enumerate(X):
        rest = F.col(x) - F.col(f"{prefix}{i}")
        for j in range(i):
            rest = rest - F.col(f"{lower}{i}{j}") * z[j]
        z.append(rest / F.col(f"{lower}{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _factor(params: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """The Cholesky factor of the covariance c_ij and its log determinant.

    ``RIDGE`` is added to the variances first, so the determinants that are
    compared are those of the regularized matrix, which is never singular.
    """
    out = params
    for i, x in enumerate(X):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}")
            if i == j:
                value = value + F.lit(RIDGE[x] ** 2)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(RIDGE[x] ** 2 / 4))) if i == j else value / F.col(f"l{j}{j}"))
    size = sum((2 * F.log(f"l{i}{i}") for i in range(1, len(X))), 2 * F.log("l00"))
    return out.select(*group, *[f"m{i}" for i in range(len(X))], *[f"l{i}{j}" for i in range(len(X)) for j in range(i + 1)], size.alias("logdet"))


def fit(stats: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Centre and Cholesky factor of the scatter of every group, as a written table.

    ``stats`` is read several times and should be a written table itself.
    """
    with scratch() as keep:
        return keep(_fit(stats, group))


def _moments(rows: DataFrame, keys: tuple[str, ...], widen: float = 1.0) -> DataFrame:
    p = len(X)
    return rows.groupBy(*keys).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)], *[(F.covar_pop(X[i], X[j]) * widen).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)])


def _starts(rows: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Three first estimates of every group: medians and MADs, all rows, rows near the median in every coordinate."""
    p = len(X)
    middle = materialize(rows.groupBy(*group).agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"m{i}") for i, x in enumerate(X)]), "quality-middle")
    off = _grouped(rows, middle, group).groupBy(*group).agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10000).alias(f"s{i}") for i, x in enumerate(X)])
    spread = materialize(_grouped(off, middle, group), "quality-spread")
    zero = F.lit(0.0)
    medians = spread.select(*group, *[f"m{i}" for i in range(p)], *[(F.pow(1.4826 * F.col(f"s{i}"), 2) if i == j else zero).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)])
    near = _grouped(rows, spread, group)
    for i, x in enumerate(X):
        near = near.where(F.abs(F.col(x) - F.col(f"m{i}")) <= 2 * 1.4826 * F.col(f"s{i}"))
    parts = [medians, _moments(rows, group), _moments(near.select(*group, *X), group)]
    first = [part.withColumn("__start", F.lit(k)) for k, part in enumerate(parts)]
    return materialize(_factor(first[0].unionByName(first[1]).unionByName(first[2]), (*group, "__start")), "quality-params")


def _fit(stats: DataFrame, group: tuple[str, ...]) -> DataFrame:
    rows = stats.where("n_words > 0").select(*group, *X)
    keys = (*group, "__start")
    widen = SUBSET / chi2_share(chi2_quantile(SUBSET, len(X)), len(X) + 2)

    def step(params: DataFrame) -> DataFrame:
        """One concentration step of every (group, start) of ``params``."""
        own = params.withColumnsRenamed({g: f"__g_{g}" for g in group})
        rated = rows.join(own, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group]).select(*keys, *X, distance().alias("d"))
        edge = rated.groupBy(*keys).agg(F.percentile_approx("d", SUBSET, 10000).alias("edge"))
        return _factor(_moments(_grouped(rated, edge, keys).where(F.col("d") <= F.col("edge")), keys, widen), keys)

    # the first estimates are no subsets: their determinants are not compared
    now = best = materialize(step(_starts(rows, group)), "quality-params")
    while now.limit(1).count():
        before = now.select(*keys, F.col("logdet").alias("__before"))
        now = materialize(_grouped(step(now), before, keys).where(F.col("logdet") < F.col("__before") - LEAST_FALL).drop("__before"), "quality-params")
        best = best.unionByName(now)
        release(rows.sparkSession)
    names = [c for c in best.columns if c not in keys]
    return materialize(best.groupBy(*group).agg(F.min_by(F.struct(*names), F.struct("logdet", "__start")).alias("b")).select(*group, *[f"b.{c}" for c in names if c != "logdet"]), "quality-params")


def judge(stats: DataFrame, params: DataFrame, group: tuple[str, ...] = GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """Adds ``distance`` (squared) and ``kept``; where a group has no estimate, the base rules alone decide."""
    extra = [c for c in params.columns if c not in group]
    out = _grouped(stats, params, group).withColumn("distance", distance())
    edge = chi2_quantile(cutoff, len(X))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= edge)).drop(*extra)


def rate(docs: DataFrame, keep: list[str], text: str = "text", group: tuple[str, ...] = GROUP) -> DataFrame:
    """``keep`` columns, statistics and verdict of every row, by estimates over all rows of ``docs``."""
    wanted = [*keep, *[g for g in group if g not in keep]]
    names = [f"__c{i}" for i in range(len(wanted))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(wanted, names, strict=True)], F.col(f"`{text}`").alias("__body"))
    rows = rows.withColumns({g: F.col(names[wanted.index(g)]) for g in group})
    stats = materialize(statistics(rows, [*names, *group], "__body"), "quality-stats")
    rated = judge(stats, fit(stats, group), group)
    return rated.drop(*group).withColumnsRenamed(dict(zip(names, wanted, strict=True)))


def keep_good(docs: DataFrame, text: str = "text", group: tuple[str, ...] = GROUP) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The statistics are computed once and written beside the rows; the estimates read only them.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    place = dict(zip(docs.columns, names, strict=True))
    named = docs.toDF(*names).select("*", *[F.col(place[g]).alias(g) for g in group], F.col(place[text]).alias("__body"))
    full = materialize(statistics(named, [*names, *group], "__body"), "quality-rows")
    return judge(full, fit(full, group), group).where("kept").select(*names).toDF(*docs.columns)
