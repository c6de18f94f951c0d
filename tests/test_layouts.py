"""Layouts that save work: change sets, evaluations bucketed by key, the search index."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateline.operators import latest, roster, search_index
from rateline.schemas import EVALUATION_KEY, PLAYERS, SUBMISSIONS
from rateline.sources import changes, keyed

ROWS = T.StructType(
    [
        T.StructField("a", T.LongType()),
        T.StructField("b.c", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
KEYS = ["a", "b.c"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, rows):
    return spark.createDataFrame([(a, b, v) for (a, b), v in rows.items()], ROWS)


def content(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return {(a, b): v for a, b, v in rows}


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


# change sets


def test_chain_equals_full_copies(spark, tmp_path):
    """Random versions with null keys and values; each is read back as it was saved."""
    draw, root, now, versions = random.Random(5), str(tmp_path / "chain"), {}, {}
    names = [(a, b) for a in (1, 2, 3, None) for b in ("x", "y", "", None)]
    kinds = []
    for version in range(1, 8):
        for _ in range(6):
            now[draw.choice(names)] = draw.choice(["p", "q", "", None])
        for _ in range(2):
            now.pop(draw.choice(names), None)
        versions[version] = dict(now)
        kinds.append(changes.save_version(table(spark, now), root, version, KEYS, chain=2))
    assert kinds == ["base", "change", "change", "base", "change", "change", "base"]
    for version, want in versions.items():
        assert content(changes.read_version(spark, root, ROWS, KEYS, version)) == want
    assert content(changes.read_version(spark, root, ROWS, KEYS)) == versions[7]


def test_change_set_names_what_happened(spark):
    old = table(spark, {(1, "x"): "p", (1, None): None, (2, "x"): "p", (3, "x"): None})
    new = table(spark, {(1, "x"): "p", (1, None): None, (2, "x"): None, (4, None): "n"})
    got = sorted(tuple(r) for r in changes.change_set(old, new, KEYS).select("a", "value", changes.OP).collect())
    assert got == [(2, None, "changed"), (3, None, "gone"), (4, "n", "added")]
    assert changes.change_set(new, new, KEYS).count() == 0
    assert changes.change_set(old, old.limit(0), KEYS).filter(f"{changes.OP} = 'gone'").count() == 4


def test_last_version_may_be_saved_again_and_no_older_one(spark, tmp_path):
    root = str(tmp_path / "chain")
    with pytest.raises(ValueError):
        changes.read_version(spark, root, ROWS, KEYS)
    changes.save_version(table(spark, {(1, "x"): "p"}), root, 1, KEYS)
    changes.save_version(table(spark, {(1, "x"): "wrong"}), root, 2, KEYS)
    changes.save_version(table(spark, {(1, "x"): "p", (2, "y"): "q"}), root, 2, KEYS)
    assert content(changes.read_version(spark, root, ROWS, KEYS)) == {(1, "x"): "p", (2, "y"): "q"}
    changes.save_version(table(spark, {}), root, 3, KEYS)
    assert content(changes.read_version(spark, root, ROWS, KEYS)) == {}
    with pytest.raises(ValueError):
        changes.save_version(table(spark, {}), root, 2, KEYS)
    with pytest.raises(ValueError):
        changes.read_version(spark, root, ROWS, KEYS, 9)


def test_what_is_written_follows_the_change(spark, tmp_path):
    root = str(tmp_path / "chain")
    rows = spark.range(50_000).select(
        F.col("id").alias("a"), F.lit("k").alias("b.c"), F.md5(F.col("id").cast("string")).alias("value")
    )
    changed = rows.withColumn("value", F.when(F.col("a") == 77, "new").otherwise(F.col("value")))
    changes.save_version(rows, root, 1, KEYS)
    changes.save_version(changed, root, 2, KEYS)
    assert size(f"{root}/change/v=2") < size(f"{root}/base/v=1") / 50
    read = changes.read_version(spark, root, ROWS, KEYS)
    assert read.count() == 50_000 and read.filter("value = 'new'").count() == 1
    assert "GreaterThan(a,49000)" in plan(read.filter("a > 49000")), "a filter reaches the full copy"


# evaluations bucketed by key


def submissions(spark, rows):
    return spark.createDataFrame(
        [(s, p, c, k, v, seq, None, None) for s, p, c, k, v, seq in rows], SUBMISSIONS
    )


def drawn(seed, n, first):
    draw = random.Random(seed)
    # One session holds a third of all rows.
    return [
        (1 if i % 3 == 0 else draw.randint(2, 40), draw.randint(1, 30), draw.randint(1, 4),
         draw.randint(0, 3), draw.randint(0, 11), first + i)
        for i in range(n)
    ]


def test_keyed_versions_equal_one_fold(spark, tmp_path):
    root, batches = str(tmp_path / "keyed"), [drawn(i, 900, i * 1000) for i in range(3)]
    one = latest.latest_evaluations(submissions(spark, batches[1]), keep_order=True)
    keyed.publish_keyed(one, root, 1, 8)
    keyed.upsert_keyed(submissions(spark, batches[0]), root, 2)
    keyed.upsert_keyed(submissions(spark, batches[2]), root, 3)
    keyed.upsert_keyed(submissions(spark, batches[2]), root, 3)  # a repeated batch
    want = latest.latest_evaluations(submissions(spark, sum(batches, [])), keep_order=True)
    got = keyed.read_keyed(spark, root)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert keyed.read_keyed(spark, root, 1).count() == one.count()


def test_stored_side_is_not_shuffled(spark, tmp_path):
    """From its scan up to the join there is no exchange, in an upsert and in a lookup, with broadcasts off."""
    root = str(tmp_path / "keyed")
    first = latest.latest_evaluations(submissions(spark, drawn(1, 3000, 0)), keep_order=True)
    keyed.publish_keyed(first, root, 1, 8)
    more = submissions(spark, drawn(2, 50, 9000))
    keyed.upsert_keyed(more, root, 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for version in (1, 2):
            stored = keyed.read_keyed(spark, root, version)
            keys = more.select(*EVALUATION_KEY).distinct()
            for df in (latest.upsert_evaluations(stored, more), stored.join(keys, EVALUATION_KEY, "right")):
                text = plan(df)
                above = text[: text.index("Bucketed: true")].splitlines()
                join = max(i for i, line in enumerate(above) if "Join" in line)
                assert not any("Exchange" in line for line in above[join:]), text
                assert "SelectedBucketsCount: 8 out of 8" in text
                assert text.count("Exchange hashpartitioning") == 2, "the batch is folded, then dealt to the buckets"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_popular_session_is_spread_over_buckets(spark, tmp_path):
    root = str(tmp_path / "keyed")
    rows = latest.latest_evaluations(submissions(spark, drawn(3, 3000, 0)), keep_order=True)
    keyed.publish_keyed(rows, root, 1, 8)
    files = keyed.read_keyed(spark, root).select("session_id", F.input_file_name().alias("f"))
    assert files.filter("session_id = 1").select("f").distinct().count() == 8
    assert files.select("f").distinct().count() == 8
    folder = str(tmp_path / "keyed" / "v=1")
    assert len([f for f in Path(folder).rglob("*.parquet")]) == 8


# search index


def some_players(spark, n, seed=1):
    draw = random.Random(seed)
    names = ["".join(draw.choices("aAbBcé ÅßİO'0179", k=draw.randint(0, 9))) for _ in range(n)]
    rows = [(i + 1, name, None, None, None, i % 5 or None) for i, name in enumerate(names)]
    rows += [(10**6 + 7, None, None, None, None, 1), (10**6 + 8, "x" * 5000, None, None, None, 2)]
    return spark.createDataFrame(rows, PLAYERS)


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    players, root = some_players(spark, 300).cache(), str(tmp_path / "index")
    search_index.save_index(players, root, 1)
    draw = random.Random(2)
    names = [r.name for r in players.select("name").collect() if r.name]
    queries = ["", "  ", "0", "a", "00", "é", "İ", "ß", "1000007", "000", "zzz", "aaaaaaaaaaaa", "x" * 4000, "'", "%", "_"]
    for _ in range(14):
        name = draw.choice(names)
        start = draw.randrange(len(name))
        queries.append(name[start : start + draw.randint(1, 6)])
    for i, query in enumerate(queries):
        division = (None, 1, 0)[i % 3]
        got = search_index.search(spark, root, query, division).collect()
        assert got == roster.player_search(players, query, division).collect(), query
    everyone = search_index.matches(spark, root, "0")
    text = F.lower(F.coalesce("name", F.lit(""))).contains("0") | F.format_string("%03d", "id").contains("0")
    assert everyone.count() == players.filter(text).count()
    assert search_index.matches(spark, root, "zzz").columns == ["id", "number", "name"]


def test_index_of_no_players_and_later_versions(spark, tmp_path):
    root, none = str(tmp_path / "index"), spark.createDataFrame([], PLAYERS)
    with pytest.raises(ValueError):
        search_index.matches(spark, root, "ann")
    search_index.save_index(none, root, 1)
    for query in ("", "a", "ann"):
        assert search_index.search(spark, root, query).count() == 0
    one = spark.createDataFrame([(5, "Ann", None, None, None, None)], PLAYERS)
    search_index.save_index(one, root, 2)
    assert search_index.search(spark, root, "ann").count() == 1
    assert search_index.search(spark, root, "ann", version=1).count() == 0


def test_a_search_reads_the_files_of_its_piece_only(spark, tmp_path):
    root = str(tmp_path / "index")
    players = spark.range(1, 30_001).select(
        "id", F.concat(F.lit("n"), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("name"),
        F.lit(None).cast("long").alias("age"), F.lit(None).cast("boolean").alias("is_pitcher"),
        F.lit(None).cast("boolean").alias("is_catcher"), F.lit(1).cast("long").alias("division_id"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        search_index.save_index(players, root, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = search_index.matches(spark, root, "beef")
    assert found.count() == players.filter("name like '%beef%'").count() > 0
    assert "EqualTo(piece," in plan(found)
    everything = spark.read.parquet(f"{root}/postings/v=1/*")
    files = everything.select("piece", F.input_file_name().alias("f"))
    rarest = re.search(r"EqualTo\(piece,(...)\)", plan(found)).group(1)
    assert rarest in ("bee", "eef")
    assert files.filter(F.col("piece") == rarest).select("f").distinct().count() < files.select("f").distinct().count()
