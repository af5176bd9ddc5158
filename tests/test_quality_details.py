from riskloom.operators import quality

from .conftest import rows


def listed(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "employment_type string")
    found = quality._listed_values(quality.invalid_values(df, "employment_type", ["employed"]), "employment_type", "text")
    return rows(found)[0]["text"]


def test_invalid_values_are_listed_by_name(spark):
    assert listed(spark, ["employed", "pirate", None, "pirate", "clown"]) == "clown, null, pirate"
    assert listed(spark, ["employed"]) == "" and listed(spark, []) == ""


def test_long_lists_end_in_an_ellipsis(spark):
    names = [f"kind{n:02d}" for n in range(quality.LISTED_VALUES + 5)]
    text = listed(spark, names)
    assert text == ", ".join(names[: quality.LISTED_VALUES]) + ", ..."
