"""Train-only preprocessing (M1–M3, M5) and the exact distributed quantile behind M1/A16.

Statistics are fitted on train rows only and applied to every row through a
join of a one-row-per-feature table.  Features are handled in long form
``(feature, x)`` so that the work spreads over features *and* rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_long(df: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "feature",
            value: str = "x") -> DataFrame:
    """Unpivot wide features to (keys..., feature, x), value cast to double."""
    cast = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features])
    return cast.unpivot(list(keys), list(features), name, value)


def exact_quantile(long: DataFrame, by: Sequence[str], q: float = 0.5, value: str = "x",
                   accuracy: int = 10000, few: bool = True) -> DataFrame:
    """Exact ``q``-quantile with linear interpolation (numpy/pandas), NULLs ignored, by one path for
    every group size and without gathering a group's values.

    Pass 1 (partial aggregates): n and an approximate bracket from ``percentile_approx`` at
    ``q -/+ 3/accuracy``; its rank error is at most n/accuracy, so the exact order statistics lie
    inside, or right beside it.  Pass 2 counts the *distinct* values inside the bracket, all values below
    as one row (with their largest) and all above as one (with their smallest), so ties are one row.  A
    running sum over those, about 6n/accuracy rows at most, picks the two ranks.  A rank that is not
    found is an error, never a NULL.  The bracket has one row per group: it is broadcast where ``few`` says that
    the groups are bounded (features), else the join is left to measured sizes."""
    by = list(by)
    x = F.col(value)
    d = 3.0 / accuracy
    lo_q, hi_q = max(0.0, q - d), min(1.0, q + d)
    valid = long.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("_x"))
    bracket = valid.groupBy(*by).agg(F.count("_x").alias("n"), F.percentile_approx("_x", [lo_q, hi_q], accuracy).alias("_b"))
    j = valid.join(F.broadcast(bracket) if few else bracket, by)
    zone = F.when(F.col("_x") < F.col("_b")[0], 0).when(F.col("_x") <= F.col("_b")[1], 1).otherwise(2)
    seen = j.groupBy(*by, "n", zone.alias("_z"), F.when(zone == 1, F.col("_x")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.max("_x").alias("_max"), F.min("_x").alias("_min"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_z", "_v"))
    seen = seen.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c"))
    pos = F.lit(q) * (F.col("n") - 1)

    def at(rank):
        return F.max(F.when((F.col("_z") == 1) & (F.col("_from") <= rank) & (rank < F.col("_upto")), F.col("_v"))
                     .when((F.col("_z") == 0) & (rank == F.col("_upto") - 1), F.col("_max"))
                     .when((F.col("_z") == 2) & (rank == F.col("_from")), F.col("_min")))

    picked = seen.groupBy(*by, "n").agg(at(F.floor(pos)).alias("_v0"), at(F.ceil(pos)).alias("_v1"))
    found = F.when(F.col("_v0").isNull() | F.col("_v1").isNull(), F.raise_error(F.lit("quantile rank outside its bracket")))
    return picked.select(*by, "n", F.coalesce(found.cast("double"), F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (
        pos - F.floor(pos))).alias("quantile"))


def fit_stats(train_long: DataFrame, feature: str = "feature", value: str = "x") -> DataFrame:
    """M1 + M2 fit: train median, mean and population std per feature.

    sklearn semantics (T6): the scaler sees the *imputed* train column, std is the
    population std and a zero std scales by 1."""
    med = exact_quantile(train_long, [feature], 0.5, value).select(feature, F.col("quantile").alias("median"))
    imp = train_long.join(F.broadcast(med), feature).select(feature, F.coalesce(F.col(value), F.col("median")).alias("_v"))
    mom = imp.groupBy(feature).agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"),
                                   F.count(F.lit(1)).alias("n_train"))
    return F.broadcast(med).join(F.broadcast(mom), feature).select(
        feature, "median", "mean", "std",
        F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)).alias("scale"), "n_train")


def impute_standardize(long: DataFrame, stats: DataFrame, feature: str = "feature", value: str = "x") -> DataFrame:
    """Apply M1 + M2: z = (coalesce(x, median) - mean) / scale."""
    j = long.join(F.broadcast(stats.select(feature, "median", "mean", "scale")), feature)
    return j.select(*[c for c in long.columns if c != value],
                    F.coalesce(F.col(value), F.col("median")).alias("imputed"),
                    ((F.coalesce(F.col(value), F.col("median")) - F.col("mean")) / F.col("scale")).alias("z"))


def class_weights(train: DataFrame, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """M5: balanced weights n / (2 * n_c) per class (per group ``by``)."""
    by = list(by)
    c = train.groupBy(*by, y).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    n = F.sum("n_class").over(w)
    k = F.count(F.lit(1)).over(w)
    return c.select(*by, y, "n_class", (n / (k * F.col("n_class"))).alias("weight"))


def sequence_standardize(rows: DataFrame, train_flag: str, nums: str = "nums") -> DataFrame:
    """M3: standardise the numeric vector of every sequence step with mean/std fitted over
    (train rows x steps), padding rows included; embeddings are left alone."""
    ex = rows.where(F.col(train_flag)).select(F.posexplode(nums).alias("j", "v"))
    st = ex.groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    arr = st.agg(F.array_sort(F.collect_list(F.struct("j", "m", "s"))).alias("st")).withColumn("_k", F.lit(1))
    return rows.withColumn("_k", F.lit(1)).join(F.broadcast(arr), "_k", "left").drop("_k").withColumn(
        nums, F.transform(nums, lambda v, i: (v - F.element_at("st", i + 1)["m"]) /
                          F.when(F.element_at("st", i + 1)["s"] > 0, F.element_at("st", i + 1)["s"]).otherwise(1.0))
    ).drop("st")
