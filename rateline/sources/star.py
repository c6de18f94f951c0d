"""The star-schema tables read as the rating model.

Nations are divisions, customers players, suppliers coaches, and line items the
submitted scores. Ids are shifted by one because 0 stands for a missing id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared, so that opening a table needs no job to look for its schema.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}

# The last nation keeps no players, so that an empty division occurs.
EMPTY_DIVISION = 25
# When the first coach was registered; the others followed a second apart.
FIRST_COACH = "1992-01-01 00:00:00"


class StarTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def divisions(self) -> DataFrame:
        return self.raw("nation").select(
            _id("n_nationkey").alias("id"), F.col("n_name").alias("name")
        )

    def players(self) -> DataFrame:
        key, segment = F.col("c_custkey"), F.col("c_mktsegment")
        return self.raw("customer").select(
            _id("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.when(key % 10 != 0, 8 + key % 7).alias("age"),
            segment.isin("BUILDING", "MACHINERY").alias("is_pitcher"),
            segment.isin("MACHINERY", "HOUSEHOLD").alias("is_catcher"),
            F.nullif(_id("c_nationkey"), F.lit(EMPTY_DIVISION).cast("bigint")).alias(
                "division_id"
            ),
        )

    def coaches(self) -> DataFrame:
        return self.raw("supplier").select(
            _id("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            (F.col("s_suppkey") == 0).alias("is_admin"),
            F.timestamp_add("SECOND", F.col("s_suppkey"), F.lit(FIRST_COACH).cast("timestamp_ntz")).alias(
                "created_at"
            ),
        )

    def _session_orders(self) -> DataFrame:
        orders, customer = self.raw("orders"), self.raw("customer")
        session = F.year("o_orderdate") * 100 + F.col("c_nationkey") + 1
        return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
            "o_orderkey",
            "o_custkey",
            "o_orderdate",
            "o_orderpriority",
            session.cast("bigint").alias("session_id"),
        )

    def submissions(self) -> DataFrame:
        # Both sides are large. Without the hint the planner overrates a joined
        # side and would rather broadcast the line items.
        items, orders = self.raw("lineitem"), self._session_orders().hint("merge")
        score = (F.col("l_quantity").cast("int") % 12).alias("score")
        return (
            items.join(orders, items.l_orderkey == orders.o_orderkey)
            .select(
                "session_id",
                _id("o_custkey").alias("player_id"),
                _id("l_suppkey").alias("coach_id"),
                ((F.col("l_linenumber") - 1) % 5).alias("skill_index"),
                score,
                ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 16).alias("line_seq"),
                F.col("o_orderdate").alias("created_at"),
                F.col("l_shipdate").alias("queued_at"),
            )
            .select(
                "session_id",
                "player_id",
                "coach_id",
                "skill_index",
                "score",
                (F.col("line_seq") + F.col("score")).alias("arrival_seq"),
                "created_at",
                "queued_at",
            )
        )

    def session_divisions(self) -> DataFrame:
        """Sessions with their division, where neither start nor end is needed."""
        return self._session_orders().select(
            F.col("session_id").alias("id"), (F.col("session_id") % 100).alias("division_id")
        ).distinct()

    def session_starts(self) -> DataFrame:
        """One start command per session, at its first submission."""
        items, orders = self.raw("lineitem"), self._session_orders()
        return (
            orders.join(items, items.l_orderkey == orders.o_orderkey, "left_semi")
            .groupBy("session_id")
            .agg(F.min("o_orderdate").alias("ts"))
            .select(
                F.lit(1).cast("bigint").alias("lane"),
                F.col("session_id").alias("seq"),
                "ts",
                F.lit("start").alias("command"),
                (F.col("session_id") % 100).alias("division_id"),
                "session_id",
            )
        )

    def session_advances(self) -> DataFrame:
        """Urgent orders ask their session to move on; starts of a day come first."""
        return (
            self._session_orders()
            .filter(F.col("o_orderpriority") == "1-URGENT")
            .select(
                F.lit(1).cast("bigint").alias("lane"),
                (F.lit(1 << 40) + F.col("o_orderkey")).alias("seq"),
                F.col("o_orderdate").alias("ts"),
                F.lit("advance").alias("command"),
                F.lit(None).cast("bigint").alias("division_id"),
                "session_id",
            )
        )

    def stream_submissions(self) -> DataFrame:
        kinds = {"view": 0, "click": 1, "purchase": 2, "signup": 3}
        skill = F.lit(None).cast("int")
        for kind, index in kinds.items():
            skill = F.when(F.col("event_type") == kind, index).otherwise(skill)
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.raw("events").select(
            F.date_format("ts", "yyyyMMdd").cast("bigint").alias("session_id"),
            _id("user_id").alias("player_id"),
            (k % 10 + 1).alias("coach_id"),
            F.coalesce(skill, F.lit(4)).alias("skill_index"),
            (F.floor("value").cast("bigint") % 12).cast("int").alias("score"),
            F.col("event_id").alias("arrival_seq"),
            F.col("ts").alias("created_at"),
            F.col("ts").alias("queued_at"),
        )

    def league_commands(self) -> DataFrame:
        """Sign-ups start and errors end a session in the user's own lane."""
        start = F.col("event_type") == "signup"
        return (
            self.raw("events")
            .filter(F.col("event_type").isin("signup", "error"))
            .select(
                _id("user_id").alias("lane"),
                F.col("event_id").alias("seq"),
                "ts",
                F.when(start, "start").otherwise("end").alias("command"),
                F.when(start, F.col("user_id") % 24 + 1).alias("division_id"),
                F.when(start, F.col("event_id") + 1).alias("session_id"),
            )
        )


def _id(column: str) -> Column:
    return (F.col(column) + 1).cast("bigint")
