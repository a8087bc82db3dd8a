import pandas as pd
import pytest

from seriesmill.operators import synth, synth_arrow


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_numbers_follow_the_order_of_ids(spark, monkeypatch, size):
    """Ranges of few ids give the numbers that one window gives."""
    monkeypatch.setattr(synth, "RANGE", size)
    keys = [f"ID{i * 7919 % 1000}" for i in range(40)] + [""]
    found = synth.numbered(spark.createDataFrame([(k, len(k)) for k in keys], "k string, extra int").repartition(5), "k", "n").toPandas()
    assert dict(zip(found.k, found.n)) == {k: i for i, k in enumerate(sorted(keys))} and list(found.columns) == ["k", "extra", "n"]
    assert synth.numbered(spark.createDataFrame([], "k string"), "k", "n").count() == 0


@pytest.mark.parametrize("make", [lambda: synth.Jittering(seed=3), lambda: synth.TSMixup(3, 5, 9, seed=3), lambda: synth_arrow.DBA(2, seed=3)])
def test_generators_do_not_depend_on_ranges(spark, monkeypatch, make):
    rows = [(f"s{u}", t, float((u * 31 + t * 17) % 23)) for u in range(9) for t in range(12)]
    df = spark.createDataFrame(rows, "unique_id string, ds int, y double")
    order = ["unique_id", "ds"]
    whole = make().transform(df).toPandas().sort_values(order, ignore_index=True)
    monkeypatch.setattr(synth, "RANGE", 2)
    parts = make().transform(df.repartition(3)).toPandas().sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(whole, parts)
    assert whole.unique_id.nunique() == 9
