"""Tests by permutation, and pairwise measures: short seeded NumPy kernels.

Groups of up to SLICE rows are dealt into buckets of groups of like size, which
share their relabellings.  Larger groups: Kendall's tau is counted by native
aggregates and windows; the permutation t test and the energy distance work on
slices and ranges of a group; mmd and distance correlation hold one group, but
not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions import options
from quillstat.functions.columns import norm_sf
from quillstat.plans.moments import double, join_groups, own_names, usable
from quillstat.sources.tables import settled, written

SCHEMA = "statistic double, p_value double, n1 int, n2 int, method string"
#: Numbers that a step of relabelling holds.
CELLS = 1 << 20


def _two(df: DataFrame, value: str, group: str, by) -> DataFrame:
    return usable(df, [value]).where(F.col(group).isNotNull()).select(*by, double(value).alias("v"), (F.col(group).cast("long") == 0).alias("first"))


#: Rows of a group are relabelled in random slices of about this many.
SLICE = 8192
#: Groups of a bucket.
BUCKET = 64


def _counted(rows: DataFrame, n: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the groups of ``n`` with its columns, n): n has the group's ``rows``; __id numbers groups by size, BUCKET to a bucket."""
    n = settled(n.withColumn("__rank", F.xxhash64(*by) if by else F.lit(0)))
    n = settled(n.orderBy("rows", "__rank").drop("__rank").withColumn("__id", F.monotonically_increasing_id()))
    return join_groups(rows, n, by).where("__id IS NOT NULL").withColumn("__bucket", F.floor(F.col("__id") / BUCKET)), n


def _two_counted(df: DataFrame, value: str, group: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """_counted of groups with two rows on both sides, values around the group's mean."""
    rows = _two(df, value, group, by)
    n = rows.groupBy(*by).agg(F.count_if("first").alias("n1"), F.count_if(~F.col("first")).alias("n2"), F.avg("v").alias("centre"), F.count(F.lit(1)).alias("rows"))
    rows, n = _counted(rows, n.where("n1 >= 2 AND n2 >= 2"), by)
    return rows.withColumn("v", F.col("v") - F.col("centre")).drop("centre"), n


def _sliced(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of larger groups in random slices.

    A slice is relabelled on its own.  Such relabellings are a subgroup of all
    of them, so the test stays exact.
    """
    slices = F.ceil(F.col("rows") / SLICE)
    return rows.where(F.col("rows") > SLICE).select(*by, "v", "first", "n1", "n2", F.floor(F.rand(0) * slices).alias("slice"))


def _by_buckets(rows: DataFrame, by: list[str], values: list[str], schema: str, kernel, most: int | None = None) -> DataFrame:
    """Results of ``kernel`` for all groups up to ``most`` rows (SLICE).

    The kernel gets the groups of a bucket that have the same number of rows, as
    arrays (group, row) of each value, in the order of the values.
    """
    keys = [f.simpleString().replace(":", " ") for f in rows.select(*by).schema.fields]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rows", "__id", *values])
        out = []
        for size, same in pdf.groupby("rows", sort=False):
            got = kernel(*[same[c].to_numpy().reshape(-1, int(size)) for c in values])
            heads = same.iloc[:: int(size)][by].reset_index(drop=True)
            out.append(pd.concat([heads, pd.DataFrame(got, columns=names)], axis=1))
        return pd.concat(out, ignore_index=True)

    small = rows.where(F.col("rows") <= (SLICE if most is None else most))
    return small.select(*by, "rows", "__id", "__bucket", *values).groupBy("__bucket").applyInPandas(run, ", ".join([*keys, schema]))


def _whole(rows: DataFrame, by: list[str], values: list[str], schema: str, kernel, most: int) -> DataFrame:
    """Results of the kernel of _by_buckets for groups of more than ``most`` rows, a group in a task."""
    keys = [f.simpleString().replace(":", " ") for f in rows.select(*by).schema.fields]
    names = [*by, *[c.strip().split(" ")[0] for c in schema.split(",")]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(values)
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], *kernel(*[pdf[c].to_numpy()[None] for c in values])[0]]], columns=names)

    return rows.where(F.col("rows") > most).select(*by, "__id", *values).groupBy("__id").applyInPandas(run, ", ".join([*keys, schema]))


def _any_above(n: DataFrame, most: int) -> bool:
    return not n.where(F.col("rows") > most).isEmpty()


def _orders(n: int, count: int, seed, least: int = 8) -> Iterator[np.ndarray]:
    """Blocks (relabelling, row) of random orders of n rows: the same for all groups of n rows."""
    rng, left = np.random.default_rng(seed), count
    while left:
        m = min(left, max(least, CELLS // n))
        yield rng.permuted(np.tile(np.arange(n), (m, 1)), axis=1)
        left -= m


def _relabelled(pdf: pd.DataFrame, o):
    """Blocks of labels (relabelling, row) of a slice whose rows are sorted; the labels seen come first."""
    f, left = pdf["first"].to_numpy(bool), int(o.n_permutations)
    rng = np.random.default_rng([int(o.random_state), int(pdf["slice"].iloc[0])])
    yield f[None]
    while left:
        m = min(left, max(8, CELLS // len(f)))
        yield rng.permuted(np.tile(f, (m, 1)), axis=1)
        left -= m


def _per(rows: DataFrame, keys: list[str], schema: str, by: list[str], kernel) -> DataFrame:
    names = [*by, *[c.strip().split(" ")[0] for c in schema.split(",")]]
    shape = ", ".join([*[f.simpleString().replace(":", " ") for f in rows.select(*by).schema.fields], schema])
    return rows.groupBy(*keys).applyInPandas(lambda pdf: pd.DataFrame([[*[pdf[c].iloc[0] for c in by], *kernel(pdf)]], columns=names), shape)


def _tested(each: DataFrame, n: DataFrame, by: list[str], alternative: str, o, method: str) -> DataFrame:
    """Statistic of the labels seen (p = 0) and the share of relabellings at least as far out."""
    seen = each.where("p = 0").select(*by, F.col("t").alias("seen"))
    t, s = F.col("t"), F.col("seen")
    far = {"two_sided": F.abs(t) >= F.abs(s) - 1e-12, "greater": t >= s - 1e-12, "less": t <= s + 1e-12}[alternative]
    out = join_groups(each, seen, by).groupBy(*by).agg(F.first("seen").alias("statistic"), (F.count_if((F.col("p") > 0) & far) + 1).alias("hits"))
    p = (F.col("hits") / (int(o.n_permutations) + 1)).alias("p_value")
    return join_groups(out, n, by).where("statistic IS NOT NULL").select(*by, "statistic", p, F.col("n1").cast("int").alias("n1"), F.col("n2").cast("int").alias("n2"), F.lit(f"{method} ({int(o.n_permutations)} permutations)").alias("method"))


@own_names
def permutation_t_test_agg(df: DataFrame, value: str, group: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Difference of means under relabelling, as a t statistic; the share of relabellings at least as far out."""
    o, by = options.read(opts, alternative="two_sided", n_permutations=10_000, random_state=42), list(by)
    if o.alternative not in ("two_sided", "greater", "less"):
        raise ValueError("option alternative must be two_sided, greater or less")
    rows, n = _two_counted(df, value, group, by)
    count, method = int(o.n_permutations), f"Permutation t-test ({int(o.n_permutations)} permutations)"

    def tested(v: np.ndarray, first: np.ndarray) -> list:
        n1, size = first.sum(axis=1), v.shape[1]
        powers, whole = np.stack([v, v * v], axis=2), np.stack([v.sum(axis=1), (v * v).sum(axis=1)], axis=1)

        def t(sums: np.ndarray, g: int) -> np.ndarray:
            k1, k2 = n1[g], size - n1[g]
            m1, m2 = sums[:, 0] / k1, (whole[g, 0] - sums[:, 0]) / k2
            within = np.maximum(0.0, sums[:, 1] - k1 * m1**2) + np.maximum(0.0, whole[g, 1] - sums[:, 1] - k2 * m2**2)
            return (m1 - m2) / np.sqrt(np.maximum(within / (size - 2), 1e-300) * (1 / k1 + 1 / k2))

        labels = first.astype(float)
        seen = [float(t(labels[g][None] @ powers[g], g)[0]) for g in range(len(v))]
        hits = np.ones(len(v))
        for orders in _orders(size, count, [int(o.random_state), 0]):
            for g, s in enumerate(seen):
                got = t(np.take(labels[g], orders) @ powers[g], g)
                hits[g] += ((np.abs(got) >= abs(s) - 1e-12) if o.alternative == "two_sided" else (got >= s - 1e-12) if o.alternative == "greater" else (got <= s + 1e-12)).sum()
        return [(s, h / (count + 1), int(k), int(size - k), method) for s, h, k in zip(seen, hits, n1, strict=True)]

    small = _by_buckets(rows, by, ["v", "first"], SCHEMA, tested)
    if not _any_above(n, SLICE):
        return small
    rows = _sliced(rows, by)

    def sums(pdf: pd.DataFrame):
        pdf = pdf.sort_values(["v", "first"])
        v = pdf["v"].to_numpy()
        got = np.concatenate([labels @ np.column_stack([v, v * v]) for labels in _relabelled(pdf, o)])
        return got[:, 0].tolist(), got[:, 1].tolist(), v.sum(), (v * v).sum()

    parts = _per(rows, [*by, "slice"], "s array<double>, q array<double>, sv double, sq double", by, sums)
    parts = parts.select(*by, "sv", "sq", F.posexplode(F.arrays_zip("s", "q")).alias("p", "z"))
    each = parts.groupBy(*by, "p").agg(F.sum("z.s").alias("s1"), F.sum("z.q").alias("q1"), F.sum("sv").alias("sv"), F.sum("sq").alias("sq"))
    m1, m2 = F.col("s1") / F.col("n1"), (F.col("sv") - F.col("s1")) / F.col("n2")
    within = F.greatest(F.lit(0.0), F.col("q1") - F.col("n1") * m1**2) + F.greatest(F.lit(0.0), F.col("sq") - F.col("q1") - F.col("n2") * m2**2)
    pooled = F.greatest(within / (F.col("n1") + F.col("n2") - 2), F.lit(1e-300))
    each = join_groups(each, n, by).select(*by, "p", ((m1 - m2) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"))
    return small.unionByName(_tested(written(each, "relabelled"), n, by, o.alternative, o, "Permutation t-test"))


@own_names
def energy_distance_agg(df: DataFrame, value: str, group: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """2 E|X-Y| - E|X-X'| - E|Y-Y'| and its permutation test: twice the integral of the squared gap of both distribution functions.

    In groups of more than SLICE rows each row takes its labels under all
    relabellings along as bits.  Ranges of the sorted rows then give sums that
    are joined by what lies before a range.
    """
    o, by = options.read(opts, n_permutations=1000, random_state=42), list(by)
    count, method = int(o.n_permutations) + 1, f"Energy distance test ({int(o.n_permutations)} permutations)"
    rows, n = _two_counted(df, value, group, by)

    def tested(v: np.ndarray, first: np.ndarray) -> list:
        n1, size = first.sum(axis=1), v.shape[1]
        gaps, place, labels = np.append(np.diff(v), np.zeros((len(v), 1)), axis=1), np.arange(1, size + 1), first.astype(float)

        def t(drawn: np.ndarray, g: int) -> np.ndarray:
            u = np.cumsum(drawn, axis=1)
            u *= 1 / n1[g] + 1 / (size - n1[g])
            u -= place / (size - n1[g])
            u *= u
            return 2 * u @ gaps[g]

        seen = [float(t(labels[g][None], g)[0]) for g in range(len(v))]
        hits = np.ones(len(v))
        for orders in _orders(size, count - 1, [int(o.random_state), 0]):
            for g, s in enumerate(seen):
                hits[g] += (t(np.take(labels[g], orders), g) >= s - 1e-12).sum()
        return [(s, h / count, int(k), int(size - k), method) for s, h, k in zip(seen, hits, n1, strict=True)]

    small = _by_buckets(rows, by, ["v", "first"], SCHEMA, tested)
    if not _any_above(n, SLICE):
        return small
    rows = _sliced(rows, by)
    shape = rows.select(*by, "v", "n1", "n2").withColumn("labels", F.lit(b"")).schema

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["v", "first"])
        bits = np.packbits(np.concatenate(list(_relabelled(pdf, o))), axis=0).T
        return pdf.drop(columns=["first", "slice"]).assign(labels=[b.tobytes() for b in bits])

    labelled = rows.groupBy(*by, "slice").applyInPandas(label, shape)
    ranges = written(labelled.orderBy(*by, "v", "labels").withColumn("range", F.spark_partition_id()), "labelled")

    def integrate(pdf: pd.DataFrame):
        pdf = pdf.sort_values("v", kind="stable")
        v, n1, n2 = pdf["v"].to_numpy(), int(pdf["n1"].iloc[0]), int(pdf["n2"].iloc[0])
        ones, first, second = np.zeros(count), np.zeros(count), np.zeros(count)
        step = max(1, CELLS // count)
        gaps = np.append(np.diff(v), 0.0)
        for at in range(0, len(v), step):
            raw = np.frombuffer(b"".join(pdf["labels"].iloc[at : at + step]), np.uint8).reshape(-1, (count + 7) // 8)
            up = ones + np.unpackbits(raw, axis=1, count=count).cumsum(axis=0)
            w = up * (1 / n1 + 1 / n2) - (at + 1 + np.arange(len(up)))[:, None] / n2
            d = gaps[at : at + step]
            first, second, ones = first + d @ w, second + d @ (w * w), up[-1]
        return int(pdf["range"].iloc[0]), len(v), n1, n2, v[0], v[-1], ones.tolist(), first.tolist(), second.tolist()

    schema = "range int, m double, n1 double, n2 double, lo double, hi double, ones array<double>, w1 array<double>, w2 array<double>"
    parts = _per(ranges, [*by, "range"], schema, by, integrate)
    parts = parts.select(*by, "range", "m", "n1", "n2", "lo", "hi", F.posexplode(F.arrays_zip("ones", "w1", "w2")).alias("p", "z"))
    order = Window.partitionBy(*by, "p").orderBy("range")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ones, m = F.coalesce(F.sum("z.ones").over(before), F.lit(0.0)), F.coalesce(F.sum("m").over(before), F.lit(0.0))
    parts = parts.withColumn("u", ones * (1 / F.col("n1") + 1 / F.col("n2")) - m / F.col("n2")).withColumn("gap", F.coalesce(F.col("lo") - F.lag("hi").over(order), F.lit(0.0)))
    u = F.col("u")
    t = 2 * F.sum(u * u * (F.col("gap") + F.col("hi") - F.col("lo")) + 2 * u * F.col("z.w1") + F.col("z.w2"))
    return small.unionByName(_tested(written(parts.groupBy(*by, "p").agg(t.alias("t")), "relabelled"), n, by, "greater", o, "Energy distance test"))


def _median_distance(v: np.ndarray) -> float:
    """Median of the distances of all pairs of sorted values; by bisection, without the pairs, when they are many."""
    n = len(v)
    if n <= 2048:
        return float(np.median((v[None, :] - v[:, None])[np.triu_indices(n, 1)]))
    pairs, at = n * (n - 1) // 2, np.arange(1, n + 1)

    def smallest(k: int) -> float:
        lo, hi = -1.0, float(v[-1] - v[0])
        for _ in range(200):
            mid = (lo + hi) / 2
            if not lo < mid < hi:
                break
            if int((np.searchsorted(v, v + mid, "right") - at).sum()) >= k:
                hi = mid
            else:
                lo = mid
        return max(0.0, hi)

    return (smallest((pairs + 1) // 2) + smallest(pairs // 2 + 1)) / 2


def _gaussian_factor(v: np.ndarray, width: float) -> np.ndarray:
    """F with F F' = the Gaussian kernel matrix of v up to 1e-14 an entry: Cholesky with pivots, so no square of the group is kept."""
    left, r = np.ones(len(v)), 0
    f = np.empty((len(v), 0))
    while r < len(v) and left[i := int(left.argmax())] > 1e-14:
        if r == f.shape[1]:
            f = np.concatenate([f, np.empty((len(v), max(16, r)))], axis=1)
        c = (np.exp(-((v - v[i]) ** 2) / (2 * width**2)) - f[:, :r] @ f[i, :r]) / np.sqrt(left[i])
        f[:, r] = c
        left = left - c * c
        left[i] = 0.0
        r += 1
    return f[:, :r]


@own_names
def mmd_agg(df: DataFrame, value: str, group: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Maximum mean discrepancy with a Gaussian kernel whose width is the median distance.

    The kernel matrix is taken as the product of a thin factor with itself.
    """
    o, by = options.read(opts, n_permutations=1000, random_state=42, bandwidth=None), list(by)
    count, method = int(o.n_permutations), f"MMD test ({int(o.n_permutations)} permutations)"
    rows, n = _two_counted(df, value, group, by)

    def tested(v: np.ndarray, first: np.ndarray) -> list:
        n1, size = first.sum(axis=1), v.shape[1]
        weights = np.where(first, 1 / n1[:, None], -1 / (size - n1[:, None]))
        factors = [_gaussian_factor(x, _median_distance(x) or 1.0) for x in v]
        seen = [float(((w @ f) ** 2).sum()) for w, f in zip(weights, factors, strict=True)]
        hits, rng, left = np.ones(len(v)), np.random.default_rng(int(o.random_state)), count
        while left:
            m = min(left, max(8, CELLS // size))
            orders = np.stack([rng.permutation(size) for _ in range(m)])
            for g, s in enumerate(seen):
                hits[g] += (((np.take(weights[g], orders) @ factors[g]) ** 2).sum(axis=1) >= s - 1e-12).sum()
            left -= m
        return [(s, h / (count + 1), int(k), int(size - k), method) for s, h, k in zip(seen, hits, n1, strict=True)]

    small = _by_buckets(rows, by, ["v", "first"], SCHEMA, tested)
    return small.unionByName(_whole(rows, by, ["v", "first"], SCHEMA, tested, SLICE)) if _any_above(n, SLICE) else small


#: Distance correlation takes the pairs of rows of groups up to this size at once; larger ones are summed along the order.
PAIRED = 128


def _centred(d: np.ndarray) -> np.ndarray:
    """Doubly centred distances of the last axis' rows."""
    return d - d.mean(axis=-2, keepdims=True) - d.mean(axis=-1, keepdims=True) + d.mean(axis=(-2, -1), keepdims=True)


def _mean_distances(v: np.ndarray) -> np.ndarray:
    """Mean distance of each value from all values."""
    order, n = np.argsort(v, kind="stable"), len(v)
    s = v[order]
    before = np.cumsum(s) - s
    out = np.empty(n)
    out[order] = (s * (2 * np.arange(n) - n) + s.sum() - 2 * before) / n
    return out


def _distance_products(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of |x[i] - x[j]| |y[i] - y[j]| over all pairs (i, j), x ascending and both around 0; by the bits of y's rank.

    The distances' product is the differences' product, and twice its negative
    for discordant pairs: these share the bits of y's rank above some level, and
    the earlier one has the bit set there.
    """
    n = len(x)
    rank = np.empty(n, np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(n)
    total = n * float(x @ y) - float(x.sum() * y.sum())
    order = np.arange(n)
    for level in range(int(n - 1).bit_length()):
        top = rank >> (level + 1)
        order = np.argsort(top, kind="stable")
        one = ((rank[order] >> level) & 1).astype(float)
        a, b = x[order], y[order]
        starts = np.flatnonzero(np.diff(top[order], prepend=-1))
        block = np.cumsum(np.diff(top[order], prepend=-1) > 0) - 1
        sums = []
        for term in (one, one * a, one * b, one * a * b):
            c = np.cumsum(term) - term
            sums.append((c - c[starts][block]) * (1 - one))
        k, sx, sy, sxy = sums
        total += 2 * float((a * sy - a * b * k - sxy + b * sx).sum())
    return 2 * total


def _distance_test(x: np.ndarray, y: np.ndarray, o) -> tuple:
    """Results for one group of any size in memory of its rows."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    x, y = x[order] - x.mean(), y[order] - y.mean()
    a, b = _mean_distances(x), _mean_distances(y)
    of = lambda p: _distance_products(x, y[p]) / n**2 - 2 * float(a @ b[p]) / n + a.mean() * b.mean()
    own = lambda v, m: max(0.0, 2 * float(v.var()) - 2 * float((m * m).mean()) + m.mean() ** 2)
    cov, va, vb = of(np.arange(n)), own(x, a), own(y, b)
    r = float(np.sqrt(max(0.0, cov) / np.sqrt(va * vb))) if va * vb > 0 else 0.0
    rng, hits = np.random.default_rng(int(o.random_state)), 0
    for _ in range(int(o.n_permutations)):
        hits += of(rng.permutation(n)) >= cov - 1e-12 * np.sqrt(va * vb)
    return r, n * cov, (hits + 1) / (int(o.n_permutations) + 1), n, "Distance correlation"


@own_names
def distance_cor_agg(df: DataFrame, x: str, y: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Distance correlation, n times the squared distance covariance, and its permutation test; four pairs at least."""
    o, by = options.read(opts, n_permutations=1000, random_state=42), list(by)
    count = int(o.n_permutations)

    def tested(x: np.ndarray, y: np.ndarray) -> list:
        size = x.shape[1]
        if size > PAIRED:
            return [_distance_test(u, v, o) for u, v in zip(x, y, strict=True)]
        d = np.abs(y[:, :, None] - y[:, None, :])
        a, b = _centred(np.abs(x[:, :, None] - x[:, None, :])), _centred(d)
        cov, va, vb = (a * b).mean(axis=(1, 2)), (a * a).mean(axis=(1, 2)), (b * b).mean(axis=(1, 2))
        both = va * vb
        r = np.where(both > 0, np.sqrt(np.maximum(0.0, cov) / np.sqrt(np.where(both > 0, both, 1.0))), 0.0)
        # rows of a sum to 0, so the distances of y need no centring; they are 0 on the diagonal
        up = np.triu_indices(size, 1)
        half, d, hits = 2 * a[:, up[0], up[1]] / size**2, d.reshape(len(d), -1), np.ones(len(x))
        seen = cov - 1e-12 * np.sqrt(both)
        for p in _orders(size, count, int(o.random_state), 1):
            for at in range(0, len(p), step := max(1, 4 * CELLS // len(up[0]))):
                q = p[at : at + step]
                pairs = q[:, up[0]] * size + q[:, up[1]]
                for g in range(len(x)):
                    hits[g] += (np.take(d[g], pairs) @ half[g] >= seen[g]).sum()
        return [(float(r[g]), float(size * cov[g]), hits[g] / (count + 1), size, "Distance correlation") for g in range(len(x))]

    rows = usable(df, [x, y]).select(*by, double(x).alias("x"), double(y).alias("y"))
    rows, n = _counted(rows, rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).where("rows >= 4"), by)
    schema = "dcor double, statistic double, p_value double, n int, method string"
    small = _by_buckets(rows, by, ["x", "y"], schema, tested)
    return small.unionByName(_whole(rows, by, ["x", "y"], schema, tested, SLICE)) if _any_above(n, SLICE) else small


#: Cells of a slice of the x order are counted in one task: 2 ** SLICE_BITS at most.
SLICE_BITS = 14
_WITHIN = (1 << 33) - 1  # monotonically_increasing_id: the partition, then 33 bits of the row in it


def _discordant(cells: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of rows with x[i] < x[j] and y[i] > y[j], from the counts c of distinct (x, y).

    Two ranks discordant with the x order share the bits of y's rank above some
    level, and the earlier one has the bit set there.  Each level counts these
    pairs inside slices of the x order, and between them from the slices' sums.
    """
    ranked = cells.orderBy(*by, "y", "x").withColumn("yr", F.monotonically_increasing_id())
    ranked = written(ranked.orderBy(*by, "x", "y").withColumn("xr", F.monotonically_increasing_id()), "ranks")
    part, row = ranked.agg(F.max(F.shiftright("yr", 33)), F.max(F.col("yr").bitwiseAND(_WITHIN))).first()
    low = int(row or 0).bit_length()
    levels = max(1, low + int(part or 0).bit_length())
    rank = F.shiftleft(F.shiftright("yr", 33), low).bitwiseOR(F.col("yr").bitwiseAND(_WITHIN))
    rows = ranked.select(*by, "c", "xr", F.shiftright("xr", SLICE_BITS).alias("slice"), rank.alias("yr"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    rows = rows.withColumn("prefix", F.expr("shiftright(yr, level + 1)")).withColumn("one", F.expr("(shiftright(yr, level) & 1) = 1"))
    keys = [*by, "level", "prefix"]
    ones, zeros = F.when(F.col("one"), F.col("c")).otherwise(0.0), F.when(F.col("one"), 0.0).otherwise(F.col("c"))
    inside = rows.withColumn("before", F.sum(ones).over(Window.partitionBy(*keys, "slice").orderBy("xr").rowsBetween(Window.unboundedPreceding, -1)))
    slices = inside.groupBy(*keys, "slice").agg(F.sum(ones).alias("ones"), F.sum(zeros).alias("zeros"), F.sum(zeros * F.coalesce("before", F.lit(0.0))).alias("d"))
    earlier = F.sum("ones").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    return slices.withColumn("d", F.col("d") + F.col("zeros") * F.coalesce(earlier, F.lit(0.0))).groupBy(*by).agg(F.sum("d").alias("d"))


@own_names
def kendall_agg(df: DataFrame, x: str, y: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Tau-a, -b or -c from counts of distinct (x, y); normal test with tie corrections.  A group may hold all rows."""
    o, by = options.read(opts, variant="tau_b", confidence_level=0.95), list(by)
    variant = str(o.variant).lower()
    rows = usable(df, [x, y]).select(*by, double(x).alias("x"), double(y).alias("y"))
    cells = written(rows.groupBy(*by, "x", "y").agg(F.count("*").cast("double").alias("c")), "cells")
    t = F.col("c")
    pairs, third = F.sum(t * (t - 1) / 2), F.sum(t * (t - 1) * (2 * t + 5))
    parts = [cells.groupBy(*by).agg(F.sum("c").alias("n"), pairs.alias("n3")), _discordant(cells, by)]
    for i, k in (("a", "x"), ("b", "y")):
        ties = cells.groupBy(*by, k).agg(F.sum("c").alias("c"))
        parts.append(ties.groupBy(*by).agg(*[v.alias(f"{q}{i}") for q, v in (("p", pairs), ("t", third), ("q", F.sum(t * (t - 1) * (t - 2))), ("m", F.count("*").cast("double")))]))
    every = parts[0]
    for other in parts[1:]:
        every = every.unionByName(other, allowMissingColumns=True)
    s = every.groupBy(*by).agg(*[F.max(c).alias(c) for c in every.columns if c not in by]).where("n >= 3")
    over = lambda a, b: F.when(b != 0, a / b)
    c = {k: F.col(k) for k in s.columns}
    n, n0 = c["n"], c["n"] * (c["n"] - 1) / 2
    s = s.withColumn("s", n0 - c["pa"] - c["pb"] + c["n3"] - 2 * c["d"])
    m, score = F.least(c["ma"], c["mb"]), F.col("s")
    tau = {"tau_a": over(score, n0), "tau_b": over(score, F.sqrt(n0 - c["pa"]) * F.sqrt(n0 - c["pb"])), "tau_c": over(2 * m * score, n * n * (m - 1))}[variant]
    v0 = (n * (n - 1) * (2 * n + 5) - c["ta"] - c["tb"]) / 18
    v1 = 4 * c["pa"] * c["pb"] / (2 * n * (n - 1))
    v2 = c["qa"] * c["qb"] / (9 * n * (n - 1) * (n - 2))
    s = s.withColumn("tau", tau).withColumn("statistic", over(score, F.sqrt(v0 + v1 + v2)))
    p = F.when(F.col("statistic").isNotNull(), 2 * norm_sf(F.abs("statistic")))
    none = F.lit(None).cast("double")
    return s.select(*by, "tau", "statistic", p.alias("p_value"), none.alias("ci_lower"), none.alias("ci_upper"), n.cast("int").alias("n"), F.lit(f"Kendall {variant}").alias("method"))
