import numpy as np
import pandas as pd

from seriesmill.plans.queries import QUERIES


def test_more_than_a_thousand_labels(spark, tmp_path):
    """Every label's mean has its three neighbours, however many labels there are."""
    x = np.random.default_rng(2).normal(size=(1300, 4)).astype(np.float32)
    labels = np.arange(1300) % 1200
    pd.DataFrame({"vec_id": np.arange(1300), "embedding": list(x), "label": labels.astype(np.int32)}).to_parquet(tmp_path / "embeddings.parquet")
    found = QUERIES["knn_embeddings"](spark, str(tmp_path)).toPandas().sort_values(["query", "rank"])
    means = pd.DataFrame(x.astype(float)).groupby(labels).mean().to_numpy()
    d = ((means[:, None] - x[None].astype(float)) ** 2).sum(axis=2)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert list(found["query"]) == list(np.repeat(np.arange(1200), 3)) and list(found.vec_id) == list(want.ravel())
