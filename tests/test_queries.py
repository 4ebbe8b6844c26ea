"""Every query with SQL against DuckDB, the others for their properties."""

import pytest

from gleaner.plans.oracle import ORACLE
from gleaner.plans.queries import QUERIES
from tests.oracle import SF, same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


def test_every_query_is_known():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"cluster_complete"}


def test_clusters_are_complete(spark):
    import numpy as np

    got = QUERIES["cluster_complete"](spark, SF).toPandas()
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().set_index("vec_id")["embedding"]
    assert sorted(got["vec_id"]) == sorted(v.index)
    far = {}
    for c, ids in got.groupby("cluster")["vec_id"]:
        assert c == min(ids)
        x = np.array([v[i] for i in ids], float)
        far[c] = x
        assert (1 - x @ x.T).max() < 0.6
    centres = list(far)
    for i, a in enumerate(centres):
        for b in centres[:i]:
            assert (1 - far[a] @ far[b].T).max() >= 0.6 - 1e-6


def test_clusters_are_those_of_a_naive_merge(spark):
    import numpy as np

    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().set_index("vec_id")["embedding"].sort_index()
    x = np.array(v.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    far = 1 - x @ x.T
    np.fill_diagonal(far, np.inf)
    clusters = {i: [i] for i in range(len(x))}
    while True:
        a, b = sorted(map(int, np.unravel_index(far.argmin(), far.shape)))
        if not far[a, b] < 0.6:
            break
        clusters[a] += clusters.pop(b)
        far[a] = far[:, a] = np.maximum(far[a], far[b])
        far[b] = far[:, b] = far[a, a] = np.inf
    want = {int(v.index[i]): int(v.index[min(c)]) for c in clusters.values() for i in c}
    assert {r.vec_id: r.cluster for r in QUERIES["cluster_complete"](spark, SF).collect()} == want


def test_mlp_is_a_stack_of_products(spark):
    import numpy as np

    from gleaner.functions.images import apply_layers

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k long, v array<double>")
    layers = [(np.array([[1.0, 0.0], [0.0, 3.0]]), np.array([0.5, 0.0])), (np.array([[1.0, 1.0]]), np.array([-1.0]))]
    assert {r.k: r.score for r in apply_layers(df, "k", "v", layers).collect()} == {1: 6.5, 2: None}
    for rows in ([(1, None), (2, None)], []):
        assert {r.score for r in apply_layers(spark.createDataFrame(rows, "k long, v array<double>").coalesce(1), "k", "v", layers).collect()} <= {None}


def test_prediction_lines(spark):
    lines = [r.value for r in QUERIES["prediction_report"](spark, SF).collect()]
    assert lines.pop(0) == "filepath,predicted_label,confidence,similarity_illust,similarity_photo"
    assert len(lines) == 500 and all(x.startswith('"v/') and len(x.split(",")) == 5 for x in lines)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
