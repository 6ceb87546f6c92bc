import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstat.operators import robust as R


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(8)
    n = {"a": 400, "b": 35, "c": 6, "d": 2, "e": 1, None: 90, "flat": 50}
    g = np.repeat(np.array(list(n), dtype=object), list(n.values()))
    pdf = pd.DataFrame({"g": g, "h": np.arange(len(g)) % 1, "x": rng.normal(5, 3, len(g)), "z": rng.normal(size=len(g))})
    pdf["y"] = 1 + 2 * pdf.x - pdf.z + rng.normal(size=len(g)) + np.where(rng.random(len(g)) < 0.1, 60, 0)
    pdf.loc[pdf.g == "flat", "x"] = 4.0  # a constant feature
    return spark.createDataFrame(pdf).repartition(5).cache()


def fits(df, by, intercept, most, monkeypatch):
    monkeypatch.setattr(R, "SMALL", most)
    monkeypatch.setattr(R, "BUCKET_ROWS", 100)  # several buckets
    named, xs = R._named(df, "y", ["x", "z"], by)
    rows = R._huber(named, xs, by, R.options.read({"fit_intercept": intercept, "tolerance": 1e-10}, **R.HUBER)).collect()
    return {tuple(r[c] for c in by): r["r"] for r in rows}


@pytest.mark.parametrize("intercept", [True, False])
def test_huber_by_buckets_is_huber_by_rounds(spark, groups, monkeypatch, intercept):
    for df, by, sizes in ((groups, ["g", "h"], (8192, 60)), (groups.where("g = 'b'"), [], (8192,))):
        want = fits(df, by, intercept, 0, monkeypatch)
        for most in sizes:  # all groups in buckets; the larger ones by rounds
            got = fits(df, by, intercept, most, monkeypatch)
            assert got.keys() == want.keys()
            for k, w in want.items():
                assert got[k].n == w.n and (got[k].intercept is None) == (w.intercept is None)
                bare = lambda r: [r.intercept or 0.0, *[np.nan if c is None else c for c in r.coefficients]]
                assert bare(got[k]) == pytest.approx(bare(w), abs=1e-6, nan_ok=True)


def test_jobs_of_a_huber_fit_of_small_groups_do_not_depend_on_its_rounds(spark, groups):
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for rounds in (1, 60):
        spark.sparkContext.setJobGroup(f"huber {rounds}", "")
        R.fit_predict_by(groups, "huber", "y", ["x", "z"], ["g"], opts={"max_iterations": rounds, "tolerance": 1e-14}).agg(F.sum("yhat")).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"huber {rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
