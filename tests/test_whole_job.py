"""Cases in which a query once did less than the whole job."""

import json
from collections import Counter

import pandas as pd
import pytest

from fieldhush.plans import q_sources
from fieldhush.streaming import timed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["scorer", "self_updating"])
def test_replay_is_scored_as_it_comes(spark, tmp_path, kind):
    """Each micro-batch gives out its rows but those of the last hours, so no state holds a whole history."""
    scorer = {"scorer": lambda stream, late: timed.timed_scorer(stream, "rec", "t", "clip_id", "x1", lateness=late),
              "self_updating": lambda stream, late: timed.timed_self_updating(stream, "rec", "t", "clip_id", ["x1", "x2"], lateness=late)}[kind]
    out = tmp_path / "o"
    got = q_sources.replay(spark, SF, scorer, str(out))
    in_batch = Counter()
    for log in (out / "_spark_metadata").iterdir():
        if log.name.isdigit():
            for line in log.read_text().splitlines()[1:]:
                in_batch[int(log.name)] += len(pd.read_parquet(json.loads(line)["path"].removeprefix("file://")))
    assert got.count() == got.select("clip_id").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert len([n for n in in_batch.values() if n]) >= 4 and max(in_batch.values()) < 0.5 * sum(in_batch.values()), in_batch
    # What the heartbeat releases is the rows of the last hours.
    assert in_batch[max(k for k, n in in_batch.items() if n)] < 0.1 * sum(in_batch.values()), in_batch


class Seen(Exception):
    pass


@pytest.mark.parametrize(("name", "module", "call", "want"), [
    ("m2_balanced_logistic", "M", "fit_pipeline", {"pca": 20}), ("m20_leave_one_site_out", "H", "fit_groups", {"pca": 20}), ("m3_weighted_boosting", "M", "fit_pipeline", {"pca": 20, "trees": 100}),
    ("m22_class_ratio_grid", "K", "k_folds", {"k": 5}), ("m26_coral_alignment", "M", "coral_pairs", {"sites": [0, 1, 2, 3, 4]}), ("m6_mixture_states", "M", "mixture_states", {"k": 16, "pca": 32}), ("m17_isolation_forest", "M", "isolation_forest", {"trees": 200}), ("m19_corrected_cross_validation", "K", "k_folds", {"k": 5})])
def test_models_have_the_surveys_size(spark, monkeypatch, name, module, call, want):
    import inspect

    from fieldhush.plans import q_models

    real = getattr(getattr(q_models, module), call)

    def spy(*a, **kw):
        got = inspect.signature(real).bind(*a, **kw)
        got.apply_defaults()
        args = got.arguments
        if "classifier" in args and "trees" in want:
            args["trees"] = args["classifier"].getMaxIter()
        assert {k: args[k] for k in want} == want
        raise Seen

    monkeypatch.setattr(getattr(q_models, module), call, spy)
    with pytest.raises(Seen):
        from fieldhush.plans import QUERIES
        QUERIES[name](spark, SF)


def test_all_components_points_and_values(spark):
    from fieldhush.plans import QUERIES

    assert QUERIES["m1_standardize_pca"](spark, SF).count() == 20
    assert QUERIES["j9_nearest_session_all"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert {r["count"] for r in QUERIES["w17_lag_context_values"](spark, SF).groupBy("vec_id").count().collect()} == {320}


def test_lag_context_rounds_halves_away_from_zero(spark, tmp_path):
    """1/128 and -3/128 are 7812.5 and -23437.5 millionths, as exact floats."""
    from fieldhush.plans import QUERIES

    rows = [(i, [1 / 128, -3 / 128], 0) for i in range(0, 150, 25)]  # all of recorder 0
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    (row,) = QUERIES["w17_lag_context"](spark, str(tmp_path)).collect()
    assert row.context == " ".join(["7813 -23438"] * 5)
