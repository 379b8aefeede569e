"""Written tables go when they are not read any more."""

import os

from fieldhush.sources import scratch


def test_drop_scratch_keeps_what_is_read(spark):
    other = scratch.materialize(spark.range(7), "other")
    with scratch.recorded() as paths:
        a = scratch.materialize(spark.range(5), "one")
        b = scratch.materialize(a.filter("id > 2"), "two")
        c = scratch.materialize(spark.range(3), "three")
    scratch.materialize(spark.range(2), "later")
    folder = scratch.scratch_dir(spark)
    held = lambda n: any(x.startswith(f"{n}-") for x in os.listdir(folder))
    assert [scratch._name(p).split("-")[0] for p in paths] == ["one", "two", "three"]
    left = scratch.drop_scratch(paths, b.join(c, "id", "left"))
    assert left == paths[1:] and not held("one") and b.count() == 2
    assert scratch.drop_scratch(left) == [] and not held("two") and not held("three")
    assert scratch.drop_scratch(paths) == [] and held("later") and other.count() == 7
