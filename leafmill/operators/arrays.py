"""Numeric kernels of images and signals (I1 to I9, I12): histograms and thresholds as aggregates, smoothing as windows or NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def luma(r: Column, g: Column, b: Column) -> Column:
    """I1."""
    return F.shiftright((77 * r + 150 * g + 29 * b).cast("int"), 8)


def histogram(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, bin, n) of whole values 0 to 255."""
    return rows.where(F.col(value).between(0, 255)).groupBy(*group, F.col(value).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentile(bins: DataFrame, group: list[str], p: float) -> DataFrame:
    """The first bin at which the running count reaches ``p`` of all."""
    running = F.sum("n").over(W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy(*group))
    return bins.withColumn("_r", running).withColumn("_t", total).where(F.col("_r") >= F.lit(p) * F.col("_t")).groupBy(*group).agg(F.min("bin").alias("percentile"))


def otsu(bins: DataFrame, group: list[str]) -> DataFrame:
    """I4: the first threshold of greatest variance between the classes; 128 where there is one bin only."""
    upto = W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*group)
    value = F.col("n") * F.col("bin")
    q = bins.select(*group, "bin", F.sum("n").over(upto).alias("w0"), F.sum(value).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(value).over(whole).alias("s"))
    w0, w1 = F.col("w0").cast("double"), (F.col("w") - F.col("w0")).cast("double")
    between = F.when(w1 > 0, w0 * w1 * F.pow(F.col("s0") / w0 - (F.col("s") - F.col("s0")) / w1, F.lit(2.0)))
    best = F.max_by("bin", F.when(F.col("between").isNotNull(), F.struct("between", (-F.col("bin")).alias("less"))))
    return q.withColumn("between", between).groupBy(*group).agg(F.coalesce(best, F.lit(128)).alias("threshold"))


def stretch(value: Column, low: Column, high: Column) -> Column:
    """Contrast stretched so that ``low`` is 0 and ``high`` is 255."""
    return F.when(high <= low, value).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), ((value - low) * 255 / F.when(high > low, high - low)).cast("int"))))


def binarise(value: Column, threshold: Column) -> Column:
    """Black or white; the threshold is kept within 60 and 215."""
    return F.when(value < F.least(F.lit(215), F.greatest(F.lit(60), threshold)), 0).otherwise(255)


def moving_average(rows: DataFrame, group: list[str], order: str, value: str, radius: int) -> DataFrame:
    """Centred mean of ``2 radius + 1`` values, fewer at the ends."""
    return rows.withColumn("smooth", F.avg(value).over(W.partitionBy(*group).orderBy(order).rowsBetween(-radius, radius)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def smoothed(signal: pd.Series, radius: pd.Series) -> pd.Series:
    """I9 over an array column; null signals stay null, empty ones empty."""

    def one(x, r):
        if x is None or len(x) == 0:
            return x
        sums = np.concatenate([[0.0], np.cumsum(np.asarray(x, float))])
        i = np.arange(len(x))
        a, b = np.maximum(i - r, 0), np.minimum(i + r + 1, len(x))
        return ((sums[b] - sums[a]) / (b - a)).tolist()

    return pd.Series([one(x, r) for x, r in zip(signal, radius)])


@F.pandas_udf(T.DoubleType())
def pitch(profile: pd.Series) -> pd.Series:
    """I8: the period of a profile: the highest peak of its autocorrelation, halved while the half is nearly as high, refined by a parabola; null if there is none."""

    def one(x):
        if x is None or len(x) < 8:
            return None
        v = np.asarray(x, float) - np.mean(x)
        n = len(v)
        if not np.any(v):
            return None
        size = 1 << (2 * n - 1).bit_length()
        f = np.fft.rfft(v, size)
        ac = np.fft.irfft(f * np.conj(f), size)[:n] / np.maximum(np.arange(n, 0, -1), 1)
        lags = np.arange(3, n // 2)
        if not len(lags):
            return None
        best = int(lags[np.argmax(ac[lags])])
        if ac[best] <= 0:
            return None
        while best >= 6 and ac[best // 2] > 0.8 * ac[best]:
            best //= 2
        a, b, c = ac[best - 1], ac[best], ac[best + 1] if best + 1 < n else ac[best]
        bend = a - 2 * b + c
        return float(best + (0.5 * (a - c) / bend if bend else 0.0))

    return pd.Series([one(x) for x in profile])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def background(pixels: pd.Series, width: pd.Series, block: pd.Series) -> pd.Series:
    """The paper's brightness: block maxima, two greatest-neighbour and three mean passes, bilinear between block centres."""

    def one(p, w, k):
        if p is None or not len(p) or w <= 0:
            return p
        img = np.asarray(p, float).reshape(-1, int(w))
        k = max(int(k), 1)
        h, wd = img.shape
        rows, cols = -(-h // k), -(-wd // k)
        pad = np.pad(img, ((0, rows * k - h), (0, cols * k - wd)), mode="edge")
        grid = pad.reshape(rows, k, cols, k).max((1, 3))
        near = lambda g: np.stack([np.pad(g, 1, mode="edge")[i : i + rows, j : j + cols] for i in range(3) for j in range(3)])
        for _ in range(2):
            grid = near(grid).max(0)
        for _ in range(3):
            grid = near(grid).mean(0)
        y = np.clip((np.arange(h) + 0.5) / k - 0.5, 0, rows - 1)
        x = np.clip((np.arange(wd) + 0.5) / k - 0.5, 0, cols - 1)
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        y1, x1 = np.minimum(y0 + 1, rows - 1), np.minimum(x0 + 1, cols - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        out = grid[y0][:, x0] * (1 - fy) * (1 - fx) + grid[y1][:, x0] * fy * (1 - fx) + grid[y0][:, x1] * (1 - fy) * fx + grid[y1][:, x1] * fy * fx
        return np.floor(out).astype(int).ravel().tolist()

    return pd.Series([one(p, w, k) for p, w, k in zip(pixels, width, block)])


def looks_like_spread(width: Column, height: Column) -> Column:
    """I12."""
    return width > height * 1.05


def split_spread(width: Column, gutter: Column) -> Column:
    """(left, right) column ranges of both pages, with an overlap of 0.4 % of the width."""
    extra = (width * 0.004).cast("int")
    return F.struct(F.lit(0).alias("left0"), F.least(width, gutter + extra).alias("left1"), F.greatest(F.lit(0), gutter - extra).alias("right0"), width.alias("right1"))
