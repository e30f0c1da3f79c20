"""Plans and figures that Spark's own estimates get wrong, at its own broadcast threshold."""

from contextlib import contextmanager

import numpy as np
import pytest


@contextmanager
def own_threshold(spark):
    """Spark's own 10 MB, under which every table of the tests is."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("radius", [3, 10])
def test_keys_of_fingerprints_are_not_broadcast(spark, tmp_path, radius):
    """A fingerprint's keys and probes are a hundred rows for one that is stored; the stored ones are under the threshold."""
    from tidemark.llm import simhash as S

    r = np.random.default_rng(1)
    base = r.integers(-(1 << 62), 1 << 62, 40)
    near = base ^ (np.int64(1) << r.integers(0, 62, 40))
    fps = stored(spark.createDataFrame([(int(x),) for x in [*base, *near]], "fp long"), tmp_path / "fps")
    with own_threshold(spark):
        links = S.links(fps, radius)
        assert "BroadcastExchange" not in plan(links) and "SortMergeJoin" in plan(links)
        found = {frozenset(x) for x in links.collect()}
    assert {frozenset((int(a), int(b))) for a, b in zip(base, near, strict=True)} <= found
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= radius for a, b in map(tuple, found))


def test_keys_of_vectors_are_not_broadcast(spark, tmp_path):
    from tidemark.llm import embedding_dedup as E

    vectors = spark.createDataFrame([(i, "a", [float(i % 3 == k) for k in range(3)]) for i in range(30)], "vec_id long, label string, embedding array<double>")
    with own_threshold(spark):
        _, every = E.nodes(stored(vectors, tmp_path / "vectors"))
        first = plan(E.links(every)).split("Generate posexplode", 1)[0]
        assert "SortMergeJoin" in first and "BroadcastExchange" not in first.rsplit("SortMergeJoin", 1)[1]
        got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in E.groups(vectors).collect()}
    assert got == {i: (9, i % 3) for i in range(30)}
