from noctua.operators import nightly


def test_negative_weekly_rhythm_is_as_rare_as_a_positive_one(spark):
    """Signs that turn every seven nights: r7 is near -1 and its p small."""
    rows = [(i, float((-1) ** (i // 7)) * (1 + i % 7)) for i in range(70)]
    got = nightly.weekly_rhythm(spark.createDataFrame(rows, "idx long, x double"), "x", 200).collect()[0]
    assert got.r7 < -0.8 and got.p < 0.02
