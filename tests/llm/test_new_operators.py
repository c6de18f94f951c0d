"""Source divergence, content sort and vector codes beside plain versions of themselves."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rateline.llm import content_sort, divergence, vector_codes

N_ODD = 9  # rows of odd_docs


# 11: source divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_audit(rows, least, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    found, docs = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        words = Counter(WORD.findall(text.translate(SMALL)))
        found[lang, source].update(words)
        docs[lang].update(words.keys())
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update(found[lang, s])

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(found[lang, s]) for s in sources}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(apart(p[s][t], q[t]), t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(items[:most])}
    return out


def audited(frame, least=3, top=4):
    return {tuple(r) for r in divergence.audit(frame, least, top).collect()}


@pytest.mark.parametrize("table, sources, piece", [(1 << 20, 512, 4 << 20), (60, 3, 40)])
def test_divergence_equals_brute_force(spark, monkeypatch, table, sources, piece):
    """Also in many small tables, blocks and slices, where most texts are taken in pieces."""
    monkeypatch.setattr(divergence, "TABLE", table)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    draw = random.Random(11)
    stock = ["Alpha", "alphabetical", "alphabet", "alphabetically", "élan", "ÉLAN", "漢字", "x", "zz9z", "İ", "😀b"]
    stock += [f"common{'abcdefgh'[i]}{'ij' * i}" for i in range(8)]
    rows = []
    for _ in range(200):
        words = draw.choices(stock, k=draw.randint(0, 25))
        rows.append((draw.choice([" ", "-", "1 ", "\n"]).join(words), draw.choice(["en", "de"]), draw.choice("abcdefgh")))
    rows += [(None, "en", "i"), ("", None, None), ("one two three", "fr", "a"), ("one two", "fr", "b"), ("Alpha x", None, "z")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    if piece < 100:  # in the tasks too: run the counting here, on the same rows
        monkeypatch.setattr(divergence, "SLICE", piece)
        flat = frame.fillna("").toArrow().combine_chunks().to_batches()
        monkeypatch.setattr(divergence, "term_counts", lambda docs: counted(spark, flat))
    assert audited(frame) == plain_audit(rows, 3, 4)


def counted(spark, batches):
    out = pa.Table.from_batches(list(divergence._count(iter(batches)))).to_pylist()
    frame = spark.createDataFrame(out, divergence._COUNTED).groupBy("lang", "source", "term")
    return frame.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def test_pointers_are_sorted_by_their_words():
    draw = random.Random(12)
    words = ["".join(draw.choices("ab", k=draw.randint(1, 30))).encode() for _ in range(3_000)]
    data = np.frombuffer(b" ".join(words) + b" " * 8, np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.append(0, np.cumsum(lengths + 1)[:-1])
    order, runs = divergence.sort_pointers(data, starts, lengths)
    assert order.tolist() == sorted(range(len(words)), key=lambda i: (words[i], i))
    assert len(runs) == len(set(words)) and words[order[runs[-1]]] == max(words)


def test_divergence_odd_input(spark, odd_docs, no_docs):
    named = odd_docs.withColumn("lang", F.lit("en")).withColumn("source", F.col("cls"))
    assert {r.part for r in divergence.audit(named, 1).collect()} == set()  # one source is its language
    two = named.withColumn("source", F.when(F.col("doc_id") > 4, "a"))
    rows = [tuple(r) for r in two.select("text", "lang", "source").collect()]
    assert audited(two, 1, 10) == plain_audit(rows, 1, 10)
    none = no_docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("a"))
    assert divergence.audit(none).count() == 0


# 12: content sort


def plain_duplicates(rows, keep):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    best = {t: keep((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    sizes = {t: len(ids) for t, ids in groups.items()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sorted(
        ((i, best[t or ""], sizes[t or ""], digest(t or "")) for i, t in rows), key=str
    )


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_content_sort_equals_brute_force(spark, keep):
    """A text of half the rows spans several ranges, whose edges it shares with others."""
    draw = random.Random(13)
    stock = ["", " ", "a", "A", "common", "common " * 200, "common " * 200 + "x", "é😀", "long " * 20_000]
    rows = [(i, "the one text of half the rows") for i in range(0, 6_000, 2)]
    rows += [(i, draw.choice([*stock, None, f"text {i}", f"text {i % 50}"])) for i in range(1, 6_000, 2)]
    rows += [(None, "a"), (None, None), (None, "alone"), (None, "alone"), (17, rows[100][1])]
    draw.shuffle(rows)
    # Batches of 50 rows, so that runs go on from batch to batch and range to range.
    settings = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": "50",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        got = content_sort.duplicates(frame, keep=keep).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plain = plain_duplicates(rows, min if keep == "smallest" else max)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain
    stays = Counter(r.text_sha256 for r in got if r.kept)
    assert set(stays.values()) == {1} and set(stays) == {r.text_sha256 for r in got}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_a_group_over_range_edges_is_one(spark):
    rows = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text"))
    got = content_sort.duplicates(rows.repartition(6))
    assert got.filter("keep_id = 0 and group_size = 4000").count() == 4_000
    assert [r.doc_id for r in got.filter("kept").collect()] == [0]


def test_content_sort_normalises_and_keeps_columns(spark, odd_docs, no_docs):
    frame = spark.createDataFrame([(3, "Some  Text"), (2, "some text"), (1, "other")], "doc_id long, text string")
    plain = lambda t: F.lower(F.regexp_replace(t, r"\s+", " "))
    assert sorted(r.text for r in content_sort.keep_one(frame, plain).collect()) == ["other", "some text"]
    kept = content_sort.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 3 4 5 None 7 8".split())
    assert content_sort.duplicates(odd_docs).count() == N_ODD
    assert content_sort.duplicates(no_docs).count() == 0 and content_sort.keep_one(no_docs).count() == 0


# 13: vector codes


def plain_codes(rows, parts, rounds, entries):
    kept = [(i, lab, np.floor(256 * np.array(x)).astype(int)) for i, lab, x in rows if x is not None and all(
        v is not None and np.isfinite(v) for v in x)]
    x = np.array([v for _, _, v in kept]).reshape(len(kept), parts, -1)
    seeds = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2].tolist()))[:entries]
    books = x[seeds].transpose(1, 0, 2).copy()

    def nearest(p, row):
        d = ((books[p] - row) ** 2).sum(1)
        return int(d.argmin()), int(d.min())

    for r in range(rounds + 1):
        found = [[nearest(p, x[k, p]) for p in range(parts)] for k in range(len(x))]
        if r < rounds:
            for p in range(parts):
                for e in {f[p][0] for f in found}:
                    own = [x[k, p] for k in range(len(x)) if found[k][p][0] == e]
                    books[p, e] = np.sum(own, 0) // len(own)
    text = ",".join(str(v) for v in books.ravel())
    codes = [(i, lab, bytes(f[0] for f in fs).hex(), sum(f[1] for f in fs)) for (i, lab, _), fs in zip(kept, found)]
    return Counter(codes), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_codes_equal_brute_force(spark, spread):
    """Ties (small whole numbers) included, with bad rows, null and repeated ids."""
    random_ = np.random.default_rng(13)
    x = np.round(random_.normal(0, spread, (300, 32)), 2)
    rows = [(int(i), [None, 1, 2][i % 3], v.tolist()) for i, v in enumerate(x)]
    rows += [(7, 1, x[8].tolist()), (None, 2, x[9].tolist()), (400, 1, None), (401, 1, [None] * 32), (402, 1, [float("inf")] * 32)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    coded, books = vector_codes.encode(frame)
    want, digest = plain_codes(rows, 16, 2, 64)
    assert Counter((r.vec_id, r.label, r.code, r.error) for r in coded.collect()) == want
    assert books.digest() == digest
    totals = Counter()
    for (_, label, _, error), n in want.items():
        totals[label] += error * n
    got = vector_codes.label_errors(coded).collect()
    assert len(got) == sum(want.values()) and all(r.label_error == totals[r.label] for r in got)


@pytest.mark.parametrize("width", [1, 2, 4, 9])
def test_cells_are_exact_and_measure_less(width):
    random_ = np.random.default_rng(width)
    entries = random_.integers(-60, 60, (64, width))
    points = random_.integers(-90, 90, (5_000, width))
    cells = vector_codes.Cells(entries)
    found, error = cells.nearest(points)
    apart = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (found == apart.argmin(1)).all() and (error == apart.min(1)).all()
    if width <= 4:
        assert cells.measured < apart.size / 2
    again = cells.nearest(points[:100])[0]
    assert (again == found[:100]).all()


def test_codes_odd_input(spark):
    schema = "vec_id long, label string, embedding array<double>, x int, code int, part int, error int"
    more = (1, 2, 3, 4)
    frame = spark.createDataFrame([(1, "a", [0.5] * 20, *more), (1, "a", [0.5] * 20, *more), (3, None, [1.0] * 7, *more)], schema)
    coded, books = vector_codes.encode(frame)  # 20 components end in zeros up to 32; the short one is left out
    assert [(r.vec_id, r.error) for r in coded.collect()] == [(1, 0), (1, 0)] and books.entries.shape == (16, 2, 2)
    none, books = vector_codes.encode(frame.limit(0))
    assert none.count() == 0 and books is None and vector_codes.label_errors(none).count() == 0
    blank = spark.createDataFrame([(1, "a", [], *more), (2, "a", None, *more)], schema)
    coded, books = vector_codes.encode(blank)
    assert [(r.code, r.error) for r in coded.collect()] == [("00" * 16, 0)]
    with pytest.raises(Exception, match="cannot be coded exactly"):
        vector_codes.encode(spark.createDataFrame([(1, "a", [1e9] * 16, *more)], schema))[0].collect()
