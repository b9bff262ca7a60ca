"""Quality rules: count features of a text and reject robust multivariate outliers by language and source.

The verdict comes from minimum-covariance-determinant (MCD) estimates for each (lang, source): three first subsets by medians and
quartiles, then concentration steps that keep the H_SHARE rows nearest by Mahalanobis distance and estimate mean and
covariance from those, until the determinant falls no more; the start with the least determinant gives the estimate. All of it is DataFrame
expressions; quantiles come from bin counts, so their state is bounded by groups times bins, and a hot group is pre-aggregated in every task.

Defined cases: a null or blank text has no words and fails the base rule; null languages or sources form groups of
their own; rows of a group too small for an estimate of its own (fewer than MIN_GROUP x H_SHARE rows behind it) are judged by one over all
rows of their language, and where that is too small too, by one over all rows, whatever their number; repeated rows are judged one by one; further columns of the input pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, cut

H_SHARE, STEPS, MIN_GROUP = 0.75, 10, 40
#: Fall of half a log determinant at which concentration ends; distances are binned, so that it may move a little for ever.
TOLERANCE = 0.001
#: Squared distance beyond which a row is rejected: the 0.999 quantile of chi-square with 4 degrees.
CUTOFF = 18.467
#: Standard deviations that stand in where a statistic hardly varies (as most texts have no symbols and no repeats, the covariance is then
#: degenerate): 0.18 is one symbol in MIN_WORDS words. Real variances above them stay as they are.
FLOORS = (0.1, 0.05, 0.18, 0.35)
#: Consistency factor of the MCD covariance at H_SHARE 0.75 in 4 dimensions.
CONSISTENCY = 1.486
#: Typical standard deviations, which count as PRIOR_ROWS rows in each covariance: for a handful of rows it is singular by itself.
PRIOR, PRIOR_ROWS = (1.0, 0.15, 0.35, 0.35), 4
#: Stands for all values of a key in pooled estimates; own values begin with = or are empty.
ANY = "*"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
P, BIN = 4, 1 / 64
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = {"n_words": "__q_n", "word_chars": "__q_c", "n_symbols": "__q_s", "n_dup_lines": "__q_d", "n_repeat_words": "__q_r"}

#: Windows of three words that occur twice: windows sorted by hash, those equal to a neighbour, their places in order, and
#: the words that these cover. array(..) with transform names a value, so that it is computed once.
REPEATED = """CASE WHEN size(array_distinct(__q_h)) = size(__q_h) THEN 0L ELSE
  element_at(transform(array(sort_array(
    element_at(transform(array(sort_array(transform(__q_h, (h, i) -> struct(h AS h, i AS i)))), s ->
      transform(filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) OR coalesce(x.h = get(s, i + 1).h, false)), x -> x.i)), 1)
  )), p -> 3L + aggregate(transform(p, (x, i) -> least(3, x - coalesce(get(p, i - 1), x))), 0L, (a, x) -> a + x)), 1) END"""


def with_counts(docs: DataFrame) -> DataFrame:
    """The rows with the five counts under the names in COUNTS' values."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("__q_w", F.array_remove(F.split(text, SPACE), ""))
    d = d.withColumn("__q_n", F.size("__q_w").cast("long"))
    d = d.withColumn("__q_h", F.expr("CASE WHEN __q_n < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, cast(__q_n AS int) - 3), i -> xxhash64(__q_w[i], __q_w[i + 1], __q_w[i + 2])) END"))
    d = d.withColumn("__q_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumns({
        "__q_c": F.length(F.array_join("__q_w", "")).cast("long"),
        "__q_s": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "__q_d": (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long"),
        "__q_r": F.expr(REPEATED),
    })
    return d.drop("__q_w", "__q_h", "__q_l")


def statistics() -> dict[str, Column]:
    """The statistic vector: logarithms of length and mean word length, and damped shares of symbols and repeated words."""
    n = F.greatest(F.col("__q_n"), F.lit(1)).cast("double")
    return {
        "__q_z0": F.log(n),
        "__q_z1": F.log(1 + F.col("__q_c") / n),
        "__q_z2": F.log(1 + 10 * F.col("__q_s") / n),
        "__q_z3": F.log(1 + 10 * F.col("__q_r") / n),
    }


GROUP = ["__q_g0", "__q_g1"]
Z = [f"__q_z{j}" for j in range(P)]


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Upper ends of the bins that hold the quantiles of a value for each key."""
    bins = cut(rows.groupBy(*keys, F.floor(F.col(value) / BIN).alias("__q_bin")).agg(F.count(F.lit(1)).alias("__q_k")), "bins")
    w = Window.partitionBy(*keys)
    bins = bins.withColumns({"__q_run": F.sum("__q_k").over(w.orderBy("__q_bin")), "__q_all": F.sum("__q_k").over(w)})
    return bins.groupBy(*keys).agg(*(F.min(F.when(F.col("__q_run") >= share * F.col("__q_all"), (F.col("__q_bin") + 1) * BIN)).alias(name) for name, share in shares.items()))


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
FACTOR = [f"__q_c{i}{j}" for i, j in PAIRS]


def estimate(near: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the number of rows in the nearest H_SHARE, their mean, the Cholesky factor of their floored covariance, and half its log determinant.

    Rows are summed by bins of their distance first, with their moments; only these sums meet by key.
    """
    sums = [F.count(F.lit(1)).alias("__q_k"), *(F.sum(z).alias(f"__q_e{j}") for j, z in enumerate(Z)), *(F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"__q_x{i}{j}") for i, j in PAIRS)]
    bins = cut(near.groupBy(*keys, F.floor(F.col("__q_d0") / BIN).alias("__q_bin")).agg(*sums), "bins")
    w = Window.partitionBy(*keys)
    bins = bins.withColumns({"__q_run": F.sum("__q_k").over(w.orderBy("__q_bin")) - F.col("__q_k"), "__q_all": F.sum("__q_k").over(w)})
    g = bins.where(F.col("__q_run") < H_SHARE * F.col("__q_all")).groupBy(*keys).agg(F.sum("__q_k").cast("double").alias("__q_m"), *(F.sum(c).alias(c) for c in (*(f"__q_e{j}" for j in range(P)), *(f"__q_x{i}{j}" for i, j in PAIRS))))
    g = g.withColumns({f"__q_u{j}": F.col(f"__q_e{j}") / F.col("__q_m") for j in range(P)})
    for i, j in PAIRS:
        v = (F.col(f"__q_x{i}{j}") / F.col("__q_m") - F.col(f"__q_u{i}") * F.col(f"__q_u{j}")) * CONSISTENCY * F.col("__q_m") / (F.col("__q_m") + PRIOR_ROWS)
        if i == j:
            v = F.greatest(v + PRIOR_ROWS * PRIOR[i] ** 2 / (F.col("__q_m") + PRIOR_ROWS), F.lit(FLOORS[i] ** 2))
        for k in range(j):
            v = v - F.col(f"__q_c{i}{k}") * F.col(f"__q_c{j}{k}")
        g = g.withColumn(f"__q_c{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"__q_c{j}{j}"))
    g = g.withColumn("__q_det", sum((F.log(f"__q_c{i}{i}") for i in range(P)), F.lit(0.0)))
    return g.select(*keys, "__q_m", "__q_det", *(f"__q_u{j}" for j in range(P)), *FACTOR)


def distance(rows: DataFrame, name: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution; expects the columns of estimate()."""
    total = F.lit(0.0)
    for i in range(P):
        y = F.col(Z[i]) - F.col(f"__q_u{i}")
        for k in range(i):
            y = y - F.col(f"__q_c{i}{k}") * F.col(f"__q_y{k}")
        rows = rows.withColumn(f"__q_y{i}", y / F.col(f"__q_c{i}{i}"))
        total = total + F.col(f"__q_y{i}") * F.col(f"__q_y{i}")
    return rows.withColumn(name, total)


def mcd(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """MCD estimates for each group of rows with GROUP and Z columns.

    From medians and quartiles STARTS first subsets are chosen: the rows that lie nearest by the sum of squares, the sum and the greatest of their deviations.
    Concentration steps go on from each until no group's determinant falls by more than TOLERANCE, at most so many; the least determinant wins.
    """
    parts = rows.select(*GROUP, F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(z).alias("z")) for j, z in enumerate(Z)))).alias("__q_e"))
    parts = parts.select(*GROUP, F.col("__q_e.j").alias("__q_j"), F.col("__q_e.z").alias("__q_z"))
    quart = quantiles(parts, [*GROUP, "__q_j"], "__q_z", {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    floor = F.element_at(F.array(*map(F.lit, FLOORS)), F.col("__q_j") + 1)
    quart = quart.withColumn("scale", F.greatest((F.col("hi") - F.col("lo")) / 1.349, floor))
    first = cut(quart.groupBy(*GROUP).agg(*(F.max(F.when(F.col("__q_j") == j, F.col(c))).alias(f"__q_{c}{j}") for j in range(P) for c in ("mid", "scale"))), "mcd")
    apart = [F.abs((F.col(z) - F.col(f"__q_mid{j}")) / F.col(f"__q_scale{j}")) for j, z in enumerate(Z)]
    starts = [sum((a * a for a in apart), F.lit(0.0)), sum(apart, F.lit(0.0)), F.greatest(*apart)]
    # Numbers of groups are counted here as well; were these tables joined by a shuffle, all rows would be dealt by group.
    near = rows.join(checked_broadcast(first), GROUP).select(*GROUP, *Z, F.posexplode(F.array(*starts)).alias("__q_start", "__q_d0"))
    keys, last = [*GROUP, "__q_start"], None
    for _ in range(steps + 1):
        est = cut(estimate(near.withColumn("__q_d0", F.log1p("__q_d0")), keys), "mcd")
        if last is not None:
            fall = F.max(F.col("old") - F.col("__q_det"))
            if (est.join(last.select(*keys, F.col("__q_det").alias("old")), keys).agg(fall).first()[0] or 0) <= TOLERANCE:  # one number
                break
        near, last = distance(rows.join(checked_broadcast(est), GROUP), "__q_d0").select(*keys, *Z, "__q_d0"), est
    of = [c for c in est.columns if c not in keys]
    return est.groupBy(*GROUP).agg(F.min_by(F.struct(*of), F.struct("__q_det", "__q_start")).alias("b")).select(*GROUP, *(f"b.{c}" for c in of if c != "__q_det"))


def group_estimates(groups: DataFrame, rows: DataFrame, steps: int, least: float) -> DataFrame:
    """An estimate for each of the groups: its own, or where fewer than least rows are behind that, its language's, or the one over all rows."""
    own = mcd(rows, steps).where(F.col("__q_m") >= least)
    small = cut(groups.join(own, GROUP, "left_anti"), "mcd")
    if small.isEmpty():
        return own
    langs = small.select("__q_g0").distinct()
    pooled = mcd(rows.join(langs, "__q_g0", "left_semi").withColumn("__q_g1", F.lit(ANY)), steps).where(F.col("__q_m") >= least).drop("__q_g1")
    out = own.unionByName(small.join(pooled, "__q_g0"))
    rest = cut(small.join(pooled, "__q_g0", "left_anti"), "mcd")
    if rest.isEmpty():
        return out
    whole = mcd(rows.withColumns(dict.fromkeys(GROUP, F.lit(ANY))), steps).drop(*GROUP)
    return out.unionByName(rest.crossJoin(F.broadcast(whole)))


def quality_rules(docs: DataFrame, steps: int = STEPS, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, keep: list[str] | None = None) -> DataFrame:
    """The rows (all columns, or those in keep) with the counts of COUNTS, base_failed, outlier_distance (null if no row passes the base rule) and kept, all prefixed __q_."""
    d = with_counts(docs).withColumns(statistics())
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    d = d.withColumns({"__q_g0": group("lang"), "__q_g1": group("source")})
    d = d.withColumn("__q_failed", (F.col("__q_n") < MIN_WORDS) | (100 * F.col("__q_r") > MAX_REPEAT_PERCENT * F.col("__q_n")))
    kept = docs.columns if keep is None else keep
    d = cut(d.select(*kept, *GROUP, *Z, *COUNTS.values(), "__q_failed"), "quality")
    est = group_estimates(d.select(*GROUP).distinct(), d.where(~F.col("__q_failed")).select(*GROUP, *Z), steps, math.ceil(min_group * H_SHARE))
    # One short row for each group: were its size not known here, all rows would be dealt by group, those of a hot one to a single task.
    d = distance(d.join(checked_broadcast(cut(est, "mcd")), GROUP, "left"), "__q_distance")
    d = d.withColumn("__q_kept", ~F.col("__q_failed") & F.coalesce(F.col("__q_distance") <= cutoff, F.lit(True)))
    return d.select(*kept, *COUNTS.values(), "__q_failed", "__q_distance", "__q_kept")
