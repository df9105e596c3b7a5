"""Panels of daily series: reshaping, calendar and lag features, rolling-origin folds, baselines and scores."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lags and rolling windows of the feature frame; the season is a week.
LAGS = (28, 29, 35, 42, 56, 91, 182, 364)
WINDOWS = (7, 28, 91)
BASE_LAG = 28
SEASON = 7


def to_long(wide: DataFrame, quantity: str = "QTY_", promo: str = "PROMO_") -> DataFrame:
    """(date, sku, brand, qty, promo) of a wide frame with one column a series; the brand is the series' name up to
    the first underscore. One stack, no join."""
    skus = sorted(c.removeprefix(quantity) for c in wide.columns if c.startswith(quantity))
    missing = [s for s in skus if promo + s not in wide.columns]
    if missing:
        raise ValueError(f"no promo column for {missing}")
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("sku"), F.col(quantity + s).cast("double").alias("qty"), F.col(promo + s).cast("int").alias("promo")) for s in skus])).alias("r")
    return wide.select(F.col("DATE").cast("date").alias("date"), rows).select("date", "r.sku", F.split("r.sku", "_")[0].alias("brand"), "r.qty", "r.promo")


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar (anonymous computus)."""
    a, b, c = year % 19, year // 100, year % 100
    d, e = divmod(b, 4)
    h = (19 * a + b - d - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    i, k = divmod(c, 4)
    week = (32 + 2 * e + 2 * i - h - k) % 7
    m = (a + 11 * h + 22 * week) // 451
    month, day = divmod(h + week - 7 * m + 114, 31)
    return date(year, month, day + 1)


#: Fixed-date national holidays of Italy, as (month, day).
FIXED_HOLIDAYS = ((1, 1), (1, 6), (4, 25), (5, 1), (6, 2), (8, 15), (11, 1), (12, 8), (12, 25), (12, 26))


def holidays(years) -> list[date]:
    days = {date(y, m, d) for y in years for m, d in FIXED_HOLIDAYS}
    return sorted(days | {x for y in years for x in (easter(y), easter(y) + timedelta(days=1))})


def calendar(dates: DataFrame) -> DataFrame:
    """Calendar features of each ``date``: weekday (Monday 0), month, day, ISO week, weekend, holiday, eve of one."""
    ends = dates.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    days = holidays(range(ends[0], ends[1] + 2)) if ends[0] is not None else [date(1970, 1, 1)]
    weekday = F.weekday("date")
    return dates.select(
        "date", weekday.alias("weekday"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"), F.weekofyear("date").alias("week"), (weekday >= 5).cast("int").alias("weekend"),
        F.col("date").isin(*days).cast("int").alias("holiday"), F.date_add("date", 1).isin(*days).cast("int").alias("holiday_eve"),
    )


def features(long: DataFrame, parity: bool = True) -> DataFrame:
    """Lag, rolling and promo features of (date, sku, qty, promo) over rows of a series; all windows share one
    shuffle and sort. Rolling values need a full window of lagged values. With ``parity`` the forward promo share is
    also null on a series' first six rows, and missing lagged values count as non-zero in the zero share."""
    w = W.partitionBy("sku").orderBy("date")
    base = long.withColumn("base", F.lag("qty", BASE_LAG).over(w)).withColumn("r", F.row_number().over(w))
    frame = lambda n: w.rowsBetween(1 - n, 0)
    full = lambda n, v: F.when(F.count("base").over(frame(n)) == n, v)
    ahead = w.rowsBetween(0, 6)
    zero = F.coalesce((F.col("base") == 0).cast("double"), F.lit(0.0)) if parity else (F.col("base") == 0).cast("double")
    gate = (F.count("promo").over(ahead) == 7) & ((F.col("r") > 6) if parity else F.lit(True))
    return base.select(
        "date", "sku", "qty", "promo", *[F.lag("qty", n).over(w).alias(f"lag_{n}") for n in LAGS],
        *[full(n, F.avg("base").over(frame(n))).alias(f"mean_{n}") for n in WINDOWS], full(28, F.stddev_samp("base").over(frame(28))).alias("std_28"),
        F.when(F.col("r") >= 28, F.avg(zero).over(frame(28))).alias("zero_share_28"), F.lag("promo", 1).over(w).alias("promo_lag1"), F.lead("promo", 1).over(w).alias("promo_lead1"),
        F.when(gate, F.avg("promo").over(ahead)).alias("promo_next7"),
    )


def folds(long: DataFrame, n_folds: int = 12, horizon: int = 28, stride: int = 28) -> DataFrame:
    """(fold, train_end, test_start, test_end): rolling origins over distinct days, built backwards; the last fold ends
    on the last day. ValueError if the days don't suffice or an argument isn't a positive integer."""
    for n in (n_folds, horizon, stride):
        if not isinstance(n, int) or isinstance(n, bool) or n < 1:
            raise ValueError("folds, horizon and stride are integers of 1 and more")
    days = [r["date"] for r in long.select("date").distinct().orderBy("date").collect()]  # one row a day
    needed = horizon + (n_folds - 1) * stride
    if needed >= len(days):
        raise ValueError(f"{needed} days are needed for testing, {len(days)} are there")
    ends = [len(days) - 1 - k * stride for k in range(n_folds)][::-1]
    rows = [(k, days[e - horizon], days[e - horizon + 1], days[e]) for k, e in enumerate(ends)]
    return long.sparkSession.createDataFrame(rows, "fold int, train_end date, test_start date, test_end date")


def baseline(long: DataFrame, fold: DataFrame, seasonal: bool) -> DataFrame:
    """(fold, date, sku, y_true, y_pred): last value of the series (of the same weekday with ``seasonal``) before the
    test window, for its rows. Folds are a column, so all are computed in one pass."""
    rows = long.crossJoin(F.broadcast(fold))  # a few folds
    day = [F.weekday("date").alias("wd")] if seasonal else [F.lit(0).alias("wd")]
    past = rows.filter("date <= train_end").select("fold", "sku", *day, "date", "qty").groupBy("fold", "sku", "wd").agg(F.max_by("qty", F.when(F.col("qty").isNotNull(), F.col("date"))).alias("y_pred"))
    test = rows.filter("date >= test_start and date <= test_end").select("fold", "date", "sku", F.col("qty").alias("y_true"), *day)
    return test.join(past, ["fold", "sku", "wd"], "left").select("fold", "date", "sku", "y_true", "y_pred")


def scores(preds: DataFrame, long: DataFrame, fold: DataFrame, season: int = SEASON) -> DataFrame:
    """(tercile, n, rmse, wape, mase, mase_defined): overall (tercile null) and by tercile of the series' mean. MASE
    is the unweighted mean over (fold, series) of mean |e| over the training data's mean seasonal step; series without
    a usable scale don't count."""
    mean = long.groupBy("sku").agg(F.avg("qty").alias("m"))
    cuts = mean.agg(F.percentile("m", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    tercile = F.when(F.col("m") <= F.col("c")[0], 1).when(F.col("m") <= F.col("c")[1], 2).otherwise(3)
    named = mean.crossJoin(F.broadcast(cuts)).select("sku", tercile.alias("tercile"))
    w = W.partitionBy("sku").orderBy("date")
    steps = long.withColumn("step", F.abs(F.col("qty") - F.lag("qty", season).over(w))).crossJoin(F.broadcast(fold)).filter("date <= train_end")
    scale = steps.groupBy("fold", "sku").agg(F.avg("step").alias("scale"))
    e = F.col("y_true") - F.col("y_pred")
    rows = preds.join(named, "sku").withColumn("e", F.abs(e))
    series = rows.groupBy("fold", "sku", "tercile").agg(F.avg("e").alias("mae")).join(scale, ["fold", "sku"], "left").withColumn("mase", F.when(F.col("scale") >= 1e-9, F.col("mae") / F.col("scale")))
    out = []
    for by in ([], ["tercile"]):
        a = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.when(F.sum(F.abs("y_true")) >= 1e-9, F.sum("e") / F.sum(F.abs("y_true"))).alias("wape"))
        b = series.groupBy(*by).agg(F.avg("mase").alias("mase"), F.count("mase").alias("mase_defined"))
        joined = a.join(b, by) if by else a.crossJoin(b).withColumn("tercile", F.lit(None).cast("int"))
        out.append(joined.select("tercile", "n", "rmse", "wape", "mase", "mase_defined"))
    return out[0].union(out[1])


def pinball(preds: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """(quantile, pinball, below): mean quantile loss of each column, and the share of values at or below it."""
    d = F.col("y_true") - F.col("q")
    long = preds.unpivot(["y_true"], list(quantiles), "quantile", "q")
    alpha = F.element_at(F.create_map(*[x for k, v in quantiles.items() for x in (F.lit(k), F.lit(v))]), F.col("quantile"))
    return long.withColumn("a", alpha).groupBy("quantile").agg(F.avg(F.greatest(F.col("a") * d, (F.col("a") - 1) * d)).alias("pinball"), F.avg((d <= 0).cast("double")).alias("below"))


def coverage(preds: DataFrame, low: str, high: str) -> DataFrame:
    return preds.agg(F.avg(F.col("y_true").between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def rearranged(preds: DataFrame, columns: list[str]) -> DataFrame:
    """Quantile columns sorted in each row, so they don't cross."""
    s = F.array_sort(F.array(*columns))
    return preds.withColumns({c: s[k] for k, c in enumerate(columns)})


def select_series(long: DataFrame, n: int = 8, most_zero: float = 0.1) -> DataFrame:
    """(sku, mean, zero_share): the n largest series by mean with few zero days."""
    s = long.groupBy("sku").agg(F.avg("qty").alias("mean"), F.avg((F.col("qty") == 0).cast("double")).alias("zero_share"))
    return s.filter(F.col("zero_share") <= most_zero).orderBy(F.desc("mean"), "sku").limit(n)
