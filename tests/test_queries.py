"""Every query with SQL gives the rows that DuckDB gives; the library stands without its training-data part."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from veldmark.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return round(float(v), 5) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in df.columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr) == want


def rows(spark, name):
    return catalogue.queries()[name](spark, SF).collect()


def points_of(spark):
    from veldmark.plans.points import points

    return points(spark, SF).collect()


def test_merged_peaks_equal_a_plain_loop(spark):
    want = []
    for series in range(5):
        known = []
        own = sorted((p.label, p.x, p.y, p.z) for p in points_of(spark) if p.pid % 5 == series)
        for t in sorted({p[0] for p in own}):
            frozen, fresh = [k[:3] for k in known], []
            for p in (q[1:] for q in own if q[0] == t):
                near = [math.dist(k, p) for k in frozen]
                if near and min(near) <= 60:
                    k = known[near.index(min(near))]
                    k[:] = [*((a * k[3] + b) / (k[3] + 1) for a, b in zip(k[:3], p, strict=True)), k[3] + 1]
                else:
                    fresh.append([*p, 1])
            known += fresh
        want += [(series, *k) for k in known]
    got = sorted((r.series, r.x, r.y, r.z, r.n) for r in rows(spark, "a26_merge_peaks"))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[0] == b[0] and a[4] == b[4] and all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a[1:4], b[1:4], strict=True))


def test_peaks_are_maxima_of_the_difference(spark):
    """Each peak lies within a pixel of a strict maximum of the filtered image, which a plain convolution with reflection gives."""
    import numpy as np

    def smooth(a, sigma):
        half = max(1, int(3 * sigma + 0.5))
        k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
        total = sum(k)
        for axis in (0, 1):
            b, n = np.zeros_like(a), a.shape[axis]
            for i in range(n):
                for j, w in enumerate(k):
                    m = (i + j - half) % (2 * n - 2)
                    np.moveaxis(b, axis, 0)[i] += w / total * np.moveaxis(a, axis, 0)[min(m, 2 * n - 2 - m)]
            a = b
        return a

    want = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        a = np.asarray(r.embedding, float).reshape(8, 8)
        d = smooth(a, 0.8) - smooth(a, 1.6)
        for y in range(1, 7):
            for x in range(1, 7):
                box = d[y - 1 : y + 2, x - 1 : x + 2]
                if d[y, x] > 0.02 and (box >= d[y, x]).sum() == 1:
                    want.setdefault(r.vec_id, []).append((y, x, d[y, x]))
    got = {}
    for r in rows(spark, "n1_peaks"):
        got.setdefault(r.vec_id, []).append((*r["at"], r.value))
    assert got.keys() == want.keys() and sum(map(len, want.values())) > 100
    for key, peaks in want.items():
        for (y, x, v), (gy, gx, gv) in zip(sorted(peaks), sorted(got[key], key=lambda p: (round(p[0]), round(p[1]))), strict=True):
            assert math.isclose(v, gv, abs_tol=1e-9) and abs(y - gy) <= 0.5 and abs(x - gx) <= 0.5


def test_consensus_counts_its_inliers(spark):
    """Each map is a translation, and as many matches as it says are within the error of it."""
    import numpy as np
    from pyspark.sql import functions as F

    from veldmark.operators import spatial
    from veldmark.plans.points import AXES, features

    found = features(spark, SF)
    matched = spatial.match_features(found.withColumn("i", F.col("label")), found.withColumn("i", F.col("label") - 1), 0.05, 900.5, by=["i"])
    pairs = {}
    for r in matched.select("i", *[F.col(f"f1.{a}").alias(f"a{a}") for a in AXES], *[F.col(f"f2.{a}").alias(f"b{a}") for a in AXES]).collect():
        pairs.setdefault(r.i, []).append((r[1:4], r[4:7]))
    got = {r.i: r for r in rows(spark, "n6_consensus")}
    assert got.keys() == pairs.keys()
    for i, r in got.items():
        shifts = np.array([np.subtract(b, a) for a, b in pairs[i]])
        if r.matrix is None:
            assert r.inliers == 0
            continue
        m = np.reshape(r.matrix, (3, 4))
        assert np.allclose(m[:, :3], np.eye(3)) and r.inliers >= 3
        near = np.linalg.norm(shifts - m[:, 3], axis=1) <= 40
        assert near.sum() == r.inliers and np.allclose(shifts[near].mean(axis=0), m[:, 3])
        best = max((np.linalg.norm(shifts - s, axis=1) <= 40).sum() for s in shifts)
        assert r.inliers >= 0.6 * best


@pytest.mark.parametrize("name", ["ml2_support_vectors", "ml3_forest", "ml4_perceptron", "ml5_probabilities"])
def test_learners_on_held_out_rows(spark, name):
    got = rows(spark, name)
    assert len(got) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    held = [r for r in got if r.held_out]
    told = lambda r: int(r.probability >= 0.5) if name == "ml5_probabilities" else r["class"]
    assert len(held) == sum(r.vec_id % 4 == 0 for r in got) and sum(told(r) == r.truth for r in held) / len(held) > 0.85


def test_every_query_has_sql_or_a_test():
    tested = {"a26_merge_peaks", "st4_peaks_by_cell", "n11_features", "n11_matches", "n1_peaks", "n6_consensus", "ml2_support_vectors", "ml3_forest", "ml4_perceptron", "ml5_probabilities"}
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == tested


def test_without_training_data_part(tmp_path):
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert 'g1_edge_weights' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'], list(q); e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    copy.mkdir()
    os.symlink(f"{root}/__spark_entry__.py", copy / "entry_link")
    (copy / "__spark_entry__.py").write_text(open(f"{root}/__spark_entry__.py").read())
    (copy / "veldmark").mkdir()
    for f in os.listdir(f"{root}/veldmark"):
        if f != "llm":
            os.symlink(f"{root}/veldmark/{f}", copy / "veldmark" / f)
    for f in ("conftest.py", "__init__.py", "test_plans.py"):
        (copy / "tests").mkdir(exist_ok=True)
        os.symlink(f"{root}/tests/{f}", copy / "tests" / f)
    # the rest's tests still pass there
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_plans.py"], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_small_negative_places_keep_their_sign(spark, tmp_path):
    """n12_elastic has -0.0 where rounding in SQL has it."""
    vectors = spark.createDataFrame([(0, 0, [0.002, 0.00022]), (1, 0, [0.002, 0.00024]), (2, 3, [-0.1, 0.2])], "vec_id long, label int, embedding array<float>")
    vectors.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {i: repr(place) for i, place in con.execute(catalogue.oracle_sql()["n12_elastic"]).fetchall()}
    assert "-0.0" in want[0]
    assert {r.vec_id: repr(r.place) for r in catalogue.queries()["n12_elastic"](spark, str(tmp_path)).collect()} == want
