"""List-in-string edge cases, names and labels."""

import pytest
from pyspark.sql import functions as F

from fieldhush.functions import parse as P


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("r")).first().r


@pytest.mark.parametrize("text, want", [("[]", []), ("nan", []), ("", []), (None, []), ("Owl", ["Owl"]), ("['A', 'B']", ["A", "B"]),
                                        ("[\"Anna's bird\", 'C']", ["Anna's bird", "C"]), ("['a, b']", ["a, b"]), ("[broken", [])])
def test_parse_list(spark, text, want):
    assert one(spark, P.parse_list("s"), s=text) == want


def test_numbers_and_first_relative(spark):
    assert one(spark, P.parse_numbers("s"), s="[-12.0, 30.0, 'x']") == [-12.0, 30.0, None]
    assert one(spark, P.first_relative("s"), s="[-12.5, 3]") == -12.5
    assert one(spark, P.first_relative("s"), s="oops") == 0.0 == one(spark, P.first_relative("s"), s="[]")


def test_species_pair_with_confidence(spark):
    at = lambda s, c: one(spark, P.species_at("s", "c", 0.5), s=s, c=c)
    assert at("['A', 'B']", "[0.9]") == ["A", "B"]
    assert at("['A', 'B', 'C']", "[0.9, 0.1]") == ["A"]
    assert at("['A', 'A']", "[0.9, 0.8]") == ["A"]
    assert at("A", "0.7") == ["A"] and at("A", "bad") == [] and at("[]", "[0.9]") == []


def test_names(spark):
    n = "Audio_Moth_3_20250317_093654.wav"
    assert one(spark, P.recorder_of("s"), s=n) == "AM3" and one(spark, P.day_of("s"), s=n) == "20250317"
    assert one(spark, P.seconds_of("s"), s=n) == 1742204214
    assert one(spark, P.recorder_of("s"), s="noise.wav") == "AM?" and one(spark, P.seconds_of("s"), s="x_99999999_999999.wav") is None


def test_labels(spark):
    trail = "['Human Presence on Trail']"
    assert one(spark, P.walking_only("s"), s=trail) and not one(spark, P.walking_only("s"), s="['Human Presence on Trail', 'Vehicle']")
    assert one(spark, P.disturbance_class("s"), s="['Gunshot', 'Vehicle']") == "gunshot"
    assert one(spark, P.human_tag(P.parse_list("s")), s="['Power tools', 'Avis']") and not one(spark, P.human_tag(P.parse_list("s")), s="['Avis']")
    assert not one(spark, P.is_simulation("s"), s=None)
