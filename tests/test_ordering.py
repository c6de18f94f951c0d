"""The distributed order operators against plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rateline.operators.ordering import in_ranges, ordered_neighbours, ordered_position


def hot_rows(spark, n=3000):
    """A third of the rows in group 7, and many equal names."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("g"),
        F.concat(F.lit("n"), (F.xxhash64("id") % 50).cast("string")).alias("name"),
        F.col("id").alias("id"),
    )


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(tuple, a.select(*columns).collect()), key=repr) == sorted(
        map(tuple, b.select(*columns).collect()), key=repr
    )


@pytest.mark.parametrize("buckets", [None, 1, 2, 16, 64])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_position_equals_window(spark, buckets, groups):
    rows = hot_rows(spark)
    total = "n" if groups else None
    got = ordered_position(rows, ["name", "id"], groups, total=total, buckets=buckets)
    window = Window.partitionBy(*groups)
    want = rows.withColumn("position", F.row_number().over(window.orderBy("name", "id")))
    if total:
        want = want.withColumn("n", F.count(F.lit(1)).over(window))
    assert same(got, want.withColumn("position", F.col("position").cast("long")))


@pytest.mark.parametrize("buckets", [None, 16])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_neighbours_equal_window(spark, buckets, groups):
    rows = hot_rows(spark)
    got = ordered_neighbours(rows, ["name", "id"], "id", groups, buckets=buckets)
    window = Window.partitionBy(*groups).orderBy("name", "id")
    want = rows.withColumn("previous", F.lag("id").over(window)).withColumn(
        "following", F.lead("id").over(window)
    )
    assert same(got, want)


def test_neighbour_value_may_be_null(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    got = ordered_neighbours(rows, ["id"], "v", buckets=16)
    window = Window.orderBy("id")
    want = rows.withColumn("previous", F.lag("v").over(window)).withColumn(
        "following", F.lead("v").over(window)
    )
    assert same(got, want)


def test_hot_group_is_cut(spark):
    """The group with a third of all rows is spread over many buckets."""
    rows = in_ranges(hot_rows(spark, 30_000), ["g", "name", "id"], 32)
    sizes = rows.groupBy("g", "_bucket").count()
    assert sizes.agg(F.max("count")).first()[0] < 30_000 / 8


def test_places_follow_the_order(spark):
    rows = in_ranges(hot_rows(spark, 5000), ["name", "id"], 16)
    got = [r.id for r in rows.orderBy("_bucket", "_place").collect()]
    assert got == [r.id for r in hot_rows(spark, 5000).orderBy("name", "id").collect()]
    assert rows.select("_bucket", "_place").distinct().count() == 5000


def test_many_buckets(spark):
    rows = hot_rows(spark, 40_000)
    got = ordered_position(rows, ["name", "id"], buckets=500)
    window = Window.orderBy("name", "id")
    want = rows.withColumn("position", F.row_number().over(window).cast("long"))
    assert same(got, want)


def test_empty_table(spark):
    rows = hot_rows(spark, 10).limit(0)
    assert ordered_position(rows, ["id"], ["g"], total="n").count() == 0
    assert ordered_neighbours(rows, ["id"], "name").count() == 0


def test_names_order_ignores_case_and_accents(spark):
    from rateline.operators.coverage import roster_positions

    players = spark.createDataFrame(
        [(1, "bob", 1), (2, "Álan", 1), (3, "alan", 1), (4, "Carl", 1), (5, "Zed", None)],
        "id long, name string, division_id long",
    )
    placed = roster_positions(players).orderBy("position").collect()
    assert [r.player_id for r in placed] == [2, 3, 1, 4]
    assert {r.roster_size for r in placed} == {4}
