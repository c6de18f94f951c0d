"""URL filter: path rules first, then a list of blocked canonical URLs.

The list is held twice: as a blocked Bloom filter of bounded size, which every
row meets by a broadcast join, and as a table of distinct canonical URLs, which
only rows that pass the filter meet, by a shuffled hash join. The join decides;
the filter never does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateline.sources.workspace import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change what a page shows. Fixed values.
TRACKING = ("ref", "fbclid", "gclid")

WORDS = 4  # 64-bit words in a block: 256 bits
BITS_PER_KEY = 12
PROBES = 6
#: 2^17 blocks are 4 MB of bits; a longer list gives more false hits, not a larger filter.
MAX_BLOCKS = 1 << 17


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end; empty without one."""
    return F.translate(
        F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER
    )


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, parameters that matter, sorted.

    Empty when there is no host.
    """
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(
        F.array_sort(
            F.filter(
                F.split(query, "&"),
                lambda p: (p != "")
                & ~p.startswith("utm_")
                & ~F.substring_index(p, "=", 1).isin(*TRACKING),
            )
        ),
        "&",
    )
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(host, path, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))
    )


def rule_column(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(value(rule))).otherwise(chosen)
    return chosen


def _probe(key: str, blocks: int) -> list[Column]:
    """Block number and the block's mask words for a key."""
    second = f"xxhash64({key}, 1)"
    places = [f"(shiftrightunsigned({second}, {8 * i}) & 255L)" for i in range(PROBES)]
    masks = [
        " | ".join(
            f"if({p} div 64 = {w}, shiftleft(1L, cast({p} % 64 as int)), 0L)" for p in places
        )
        for w in range(WORDS)
    ]
    return [F.expr(f"cast(pmod(xxhash64({key}), {blocks}) as int)").alias("_block")] + [
        F.expr(m).alias(f"_m{w}") for w, m in enumerate(masks)
    ]


def blocked_bloom(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """One row per block that holds a bit, at most ``MAX_BLOCKS`` rows; the number of blocks."""
    blocks = 64
    while blocks < min(MAX_BLOCKS, n_keys * BITS_PER_KEY / (64 * WORDS)):
        blocks *= 2
    table = (
        keys.select(*_probe(key, blocks))
        .groupBy("_block")
        .agg(*[F.bit_or(f"_m{w}").alias(f"_w{w}") for w in range(WORDS)])
    )
    return table, blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = ()) -> DataFrame:
    """Judge every row of ``pages(page_id, url)``.

    ``listed`` has a column ``url``. Returns page_id, host, path, rule, canonical,
    possible (the filter let it through), listed (the join found it) and verdict:
    the longest fitting rule's, else block for listed URLs, else allow.

    Null URLs and URLs without ``://`` have empty host, path and canonical form,
    fit no rule and are never listed, so they are allowed. Repeated rows are
    judged each; an empty list blocks nothing; other columns are left out.
    """
    keys = materialize(
        listed.select(canonical_url(F.col("url")).alias("canonical"))
        .filter("canonical <> ''")
        .distinct(),
        "listed-urls",
    )
    bloom, blocks = blocked_bloom(keys, "canonical", keys.count())
    host, path = F.col("host"), F.col("path")
    judged = pages.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        canonical_url(F.col("url")).alias("canonical"),
    ).select(
        "*",
        rule_column(host, path, rules, lambda r: r.text).alias("rule"),
        rule_column(host, path, rules, lambda r: r.verdict).alias("_ruled"),
        *_probe("canonical", blocks),
    )
    inside = F.lit(True)
    for w in range(WORDS):
        inside &= F.col(f"_w{w}").bitwiseAND(F.col(f"_m{w}")) == F.col(f"_m{w}")
    tested = judged.join(F.broadcast(bloom), "_block", "left").select(
        *["page_id", "host", "path", "rule", "canonical", "_ruled"],
        (F.coalesce(inside, F.lit(False)) & (F.col("canonical") != "")).alias("possible"),
    )
    hits = tested.filter("possible").join(
        keys.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left"
    )
    rest = tested.filter("not possible").withColumn("listed", F.lit(False))
    return (
        hits.unionByName(rest)
        .withColumn("listed", F.coalesce("listed", F.lit(False)))
        .withColumn(
            "verdict",
            F.coalesce("_ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))),
        )
        .select("page_id", "host", "path", "rule", "verdict", "canonical", "possible", "listed")
    )
