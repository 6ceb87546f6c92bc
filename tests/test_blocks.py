import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstat.operators import linear as L
from quillstat.operators import robust as R
from quillstat.plans import order
from quillstat.sources import tables

FRAMES = [(None, -1), (None, 0), (None, -5), (None, 2), (-11, 0), (-3, 2), (-5, -2), (2, 12), (-25, 3)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = [60, 9, 33]
    g = np.repeat(["a", "b", "c"], n)
    pdf = pd.DataFrame({"g": g, "t": rng.permutation(len(g)), "x": rng.normal(size=len(g)), "w": rng.integers(0, 3, len(g)).astype(float), "k": 1})
    pdf["y"] = 1 + 2 * pdf.x + rng.normal(size=len(g))
    pdf.loc[[3, 11, 70], "y"] = np.nan
    return pdf.sort_values(["g", "t"], ignore_index=True), spark.createDataFrame(pdf).repartition(5).cache()


def frames_of(pdf, frame):
    """(row, rows of its frame, last row of its frame) in the order of g, t."""
    for _, part in pdf.groupby("g"):
        for i in range(len(part)):
            lo, hi = 0 if frame[0] is None else max(0, i + frame[0]), min(len(part) - 1, i + frame[1])
            yield part.index[i], part.iloc[lo : hi + 1] if hi >= lo else part.iloc[:0]


@pytest.mark.parametrize("frame", FRAMES)
def test_windows_by_blocks_are_refits(spark, rows, monkeypatch, frame):
    pdf, df = rows
    monkeypatch.setattr(order, "BLOCK", 7)  # several blocks, and frames over more than one of them
    for kind in ("ols", "wls"):
        out = L.fit_predict_window(df, kind, "y", ["x"], ["g"], ["t"], frame=frame, weight="w" if kind == "wls" else None)
        got = out.toPandas().sort_values(["g", "t"], ignore_index=True)
        assert len(got) == len(pdf)
        for i, f in frames_of(pdf, frame):
            use = f[~np.isnan(f.y) & ((f.w > 0) | (kind == "ols"))]
            if len(use) <= 2:
                assert np.isnan(got.yhat[i])
                continue
            s = np.sqrt(use.w) if kind == "wls" else np.ones(len(use))
            b = np.linalg.lstsq(np.column_stack([s, s * use.x]), s * use.y, rcond=None)[0]
            assert got.yhat[i] == pytest.approx(b[0] + b[1] * f.x.iloc[-1], abs=1e-7)


@pytest.mark.parametrize("kind", ["huber", "ransac", "theilsen"])
@pytest.mark.parametrize("frame", [(-11, 0), (-3, 2), (-5, -2), (2, 12)])
def test_robust_windows_by_blocks(spark, rows, monkeypatch, kind, frame):
    pdf, df = rows
    one = R.fit_predict_window(df, kind, "y", ["x"], ["g"], ["t"], frame=frame).toPandas().sort_values(["g", "t"], ignore_index=True)
    monkeypatch.setattr(order, "BLOCK", 7)
    got = R.fit_predict_window(df, kind, "y", ["x"], ["g"], ["t"], frame=frame).toPandas().sort_values(["g", "t"], ignore_index=True)
    assert got.yhat.to_numpy() == pytest.approx(one.yhat.to_numpy(), abs=1e-9, nan_ok=True)
    for i, f in frames_of(pdf, frame):
        assert np.isnan(got.yhat[i]) == (f.y.notna().sum() <= 2)
        if kind == "huber" and f.y.notna().sum() > 2:  # the point where the weighted equations hold
            z, v = np.column_stack([np.ones(len(f)), f.x])[f.y.notna()], f.y[f.y.notna()].to_numpy()
            b = np.linalg.lstsq(z, v, rcond=None)[0]
            for _ in range(100):
                e = np.abs(v - z @ b)
                s = max(np.median(e) / 0.6744897501960817, 1e-12)
                w = np.where(e <= 1.35 * s, 1.0, 1.35 * s / np.maximum(e, 1e-300))
                new = np.linalg.pinv(z.T @ (w[:, None] * z)) @ (z.T @ (w * v))
                moved, b = np.abs(new - b).max(), new
                if moved < 1e-5:
                    break
            assert got.yhat[i] == pytest.approx(b[0] + b[1] * f.x.iloc[-1], abs=1e-6)


def test_counts_over_frames_and_plans_by_blocks(spark, rows, monkeypatch):
    pdf, df = rows
    monkeypatch.setattr(order, "BLOCK", 7)
    w = Window.partitionBy("g").orderBy("t").rowsBetween(-4, 1)
    want = {(r.g, r.t): (r.n, r.s) for r in df.select("g", "t", F.count(F.lit(1)).over(w).alias("n"), F.sum("w").over(w).alias("s")).collect()}
    got = order.over_frames(df, ["g"], ["t"], (-4, 1), {"n": lambda w: F.count(F.lit(1)).over(w), "s": lambda w: F.sum("w").over(w)})
    assert {(r.g, r.t): (r.n, r.s) for r in got.collect()} == want
    for out in (got, L.fit_predict_window(df, "ols", "y", ["x"], ["g"], ["t"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert all("__block" in line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_a_task_of_a_window_gets_a_bounded_share_of_the_rows(spark, rows, monkeypatch):
    pdf, df = rows
    monkeypatch.setattr(order, "BLOCK", 4)
    monkeypatch.setattr(order, "TASK_ROWS", 10)
    sizes = lambda out: [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert order.tasks(df) == 11 and len(sizes(order.in_order(df, ["g"], ["t"]))) > 8
    assert order.in_order(df, ["g"], ["t"]).toPandas().equals(pdf)
    robust = R.fit_predict_window(df, "huber", "y", ["x"], ["g"], ["t"], frame=(-3, 0))
    for out in (L.fit_predict_window(df, "ols", "y", ["x"], ["g"], ["t"]), robust, order.over_frames(df, ["g"], ["t"], (-3, 0), {"n": lambda w: F.count("y").over(w)})):
        assert len(sizes(out)) > 4 and sum(sizes(out)) == len(pdf)  # more partitions than spark.sql.shuffle.partitions here


def test_theilsen_frames_fit_all_subsets_of_their_rows(spark, rows):
    pdf, df = rows
    got = R.fit_predict_window(df, "theilsen", "y", ["x"], ["g"], ["t"], frame=(-11, 0)).toPandas().sort_values(["g", "t"], ignore_index=True)
    o = R.options.read(None, **R.THEILSEN)
    for i, f in frames_of(pdf, (-11, 0)):
        use = f[f.y.notna()]
        if len(use) > 2:  # at most 66 pairs, and all of them count
            b = R.theilsen_kernel(np.column_stack([np.ones(len(use)), use.x]), use.y.to_numpy(), o)
            assert got.yhat[i] == pytest.approx(b[0] + b[1] * f.x.iloc[-1], abs=1e-5)


@pytest.mark.parametrize("kind", ["huber", "theilsen"])
def test_robust_windows_store_and_shuffle_only_what_the_result_needs(spark, rows, monkeypatch, kind):
    pdf, df = rows
    monkeypatch.setattr(order, "BLOCK", 7)
    stored = []
    monkeypatch.setattr(order, "written", lambda out, *args, real=order.written, **kw: stored.append(out.columns) or real(out, *args, **kw))
    out = R.fit_predict_window(df.withColumn("text", F.lit("far too long")), kind, "y", ["x"], ["g"], ["t", "w"], frame=(-4, 1), keep=["t", "k"], over={"n": lambda w: F.count(F.lit(1)).over(w), "s": lambda w: F.sum("k").over(w)})
    assert out.columns == ["t", "k", "n", "s", "yhat"] and stored == [["g", "t", "k", "__y", "__x0", "__ok", "__id"]]  # once, without w and text
    plain = R.fit_predict_window(df, kind, "y", ["x"], ["g"], ["t"], frame=(-4, 1)).toPandas().sort_values("t")
    got = out.toPandas().sort_values("t")
    assert got.yhat.to_numpy() == pytest.approx(plain.yhat.to_numpy(), abs=1e-9, nan_ok=True)
    assert dict(zip(got.t, got.n, strict=True)) == {pdf.t[i]: len(f) for i, f in frames_of(pdf, (-4, 1))} and (got.n == got.s).all()


def test_a_stored_table_takes_its_shuffle_files_with_it(spark, rows):
    before = spark.conf.get(tables.FILE_CLEANUP, None)
    files = lambda: {f for f in spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    had = files()
    out = tables.written(rows[1].repartition(3, "g"), "test", clean=True)
    assert not files() - had and out.count() == len(rows[0])
    assert spark.conf.get(tables.FILE_CLEANUP, None) == before
