"""Each operator beside a plain version of itself, and on odd, empty and clashing input."""

import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rateline.llm import (
    jaccard,
    langid,
    licenses,
    mixing,
    packing,
    pii,
    quality_rules,
    topk,
    toxicity,
    urls,
)

N_ODD = 9  # rows of odd_docs
FOLDER = "/root/testdata/sf0.001"


# 1: personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def plain_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans_equal_the_plain_patterns(spark):
    draw = random.Random(3)
    texts = ["1" * 900, "a" * 900, "1 " * 900, "a@b.c_d@e.f@g.h", "a@b.c" * 30]
    texts += ["é😀 x@y.zz 1.2.3.4.5.6.7.8 +4 (555)123-4567 999.1.1.1 001.02.3.0255 4111 1111-1111 1111"]
    texts += ["".join(draw.choices("a1.@+- ()%_é😀\n4", k=draw.randint(1, 50))) for _ in range(800)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.spans(frame).select("doc_id", pii.written(F.col("base"))).collect()
    assert {i: s for i, s in got} == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_long_runs_take_linear_time(spark):
    texts = ["1" * 200_000, "a" * 200_000, "1 " * 100_000, "+" * 200_000, "1." * 100_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.spans(frame).filter(F.size("base") > 0).count() == 1  # 1.1.1.1 and so on


def test_terms_that_give_an_entity_away_are_found_and_removed(spark):
    texts = [f"filler{'abcdef'[i % 6]} words about nothing at all today" for i in range(400)]
    for i in range(6):
        texts[i * 9] = f"note {'pqrstu'[i] * 4} from Zebulon at zeb@corp.example on the case"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0]
    assert all("Zebulon" not in clean[i * 9] and "zeb@" not in clean[i * 9] for i in range(6))
    assert all(clean[i] == t for i, t in enumerate(texts) if "@" not in t)


def test_a_term_is_marked_all_over_the_rows_that_name_the_entity(spark):
    """A name in the first line, far above the address, and many words below it."""
    texts = [f"filler{'abcdef'[i % 6]} words about nothing at all today" for i in range(400)]
    for i in range(8):
        near = f"ask {'pqrstuvw'[i] * 4} Zebulon at zeb@corp.example"
        texts[i * 9] = f"Zebulon wrote\n{'plain words ' * 40}\n{near}\n{'plain words ' * 200}Zebulon"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Zebulon" not in clean[i * 9] and "zeb@" not in clean[i * 9] for i in range(8))
    spans = pii.spans(docs).filter("doc_id = 0").first()
    assert {texts[0][t.start : t.end].lower() for t in spans.terms} >= {"zebulon", "ask"}


@pytest.mark.parametrize("n, share", [(400, 1), (400, 2), (20, 1), (40, 10)])
def test_entities_named_seldom_or_often_are_judged(spark, n, share):
    """Named once, in two copies of a text, in a table of 20 rows, in a quarter of all rows."""
    texts = [f"filler{'abcdef'[i % 6]} words about nothing at all today" for i in range(n)]
    for i in range(share):
        texts[2 * i] = "words about nothing from Zebulon at zeb@corp.example today"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Zebulon" not in clean[2 * i] and "words about nothing" in clean[2 * i] for i in range(share))
    assert all(clean[i] == t for i, t in enumerate(texts) if "@" not in t)


def test_terms_of_a_domain_are_pooled(spark):
    """Every address is named once, but together they give the company away."""
    texts = [f"filler{'abcdef'[i % 6]} words about nothing at all today" for i in range(400)]
    for i in range(8):
        texts[i * 9] = f"Corpus words about nothing {'plain words ' * 20} today user{i}@corp.example"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Corpus" not in clean[i * 9] and "words about nothing" in clean[i * 9] for i in range(8))


def test_words_are_shuffled_in_steps_that_are_removed(spark, steps):
    """What is left to the last step are the rows found and the terms marked in them."""
    texts = [f"filler{'abcdef'[i % 6]} words about nothing at all today" for i in range(400)]
    texts[7] = "words about nothing from Zebulon at zeb@corp.example today"
    rows = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert steps() == {"pii-found", "pii-marked"}
    assert "Zebulon" in [texts[7][t.start : t.end] for r in rows.collect() for t in r.terms if r.doc_id == 7]


def test_places_of_many_matches_are_those_in_the_text(spark):
    text = "ab@c.de " + " ".join(f"wo{'abcdefghij'[i % 10]}é😀" for i in range(3 * pii._RUN + 5))
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(row.places) == 3 * pii._RUN + 5
    assert all(text[p.start : p.end] == p.term for p in row.places)


def test_sanitise_keeps_rows_and_columns(spark, odd_docs, no_docs):
    rows = pii.sanitise(odd_docs)
    assert rows.columns == odd_docs.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, odd_docs.collect()))
    assert pii.spans(odd_docs).count() == N_ODD
    assert pii.sanitise(no_docs).count() == 0 and pii.spans(no_docs).count() == 0


# 2: exact top-k


def test_top_k_equals_brute_force_with_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    random_ = np.random.default_rng(5)
    x = random_.integers(-2, 3, (160, 6)) / 2.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())]
    rows += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6)]
    rows += [(None, x[0].tolist()), (550, [1.0, 2.0]), (600, []), (604, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame, 5, 50).collect()}
    q = np.floor(x * 256).astype(int)
    want = {(550, 1): (604, 128 * 256 + 128 * 512)}
    for i in range(0, 160, 50):
        order = sorted((-(q[i] @ q[j]), j) for j in range(160) if j != i)[:5]
        want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(order)}
    assert got == want
    assert topk.top_k(frame.limit(0), 5, 50).count() == 0


def test_top_k_resolves_few_pairs(spark, monkeypatch):
    """Pairs of which no list says that they may be among the best are never added up."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "HEADS", 10)
    random_ = np.random.default_rng(7)
    middles = random_.normal(size=(20, 16))
    x = np.round(middles[np.arange(600) % 20] + random_.normal(scale=0.2, size=(600, 16)), 3)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    resolved, totals = [], topk._totals

    def counted(entries, rows):
        resolved.append(entries.select("query_id", "vec_id").distinct().count())
        return totals(entries, rows)

    monkeypatch.setattr(topk, "_totals", counted)
    got = [tuple(r) for r in topk.top_k(frame, 5, 10).orderBy("query_id", "rank").collect()]
    q = np.floor(x * 256).astype(np.int64)
    want = []
    for i in range(0, 600, 10):
        order = sorted((-(q[i] @ q[j]), j) for j in range(600) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(order)]
    assert got == want
    assert len(resolved) == 2 and resolved[0] <= 60 * 2 * topk.HEADS and resolved[1] < 60 * 599 / 4


def test_top_k_says_when_scores_do_not_fit(spark):
    frame = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1e8, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(frame, 5, 50).count()


# 3: toxicity


def test_pairs_of_terms_are_learned():
    """Neither term alone is toxic, only both together: no additive weights fit this."""
    draw = random.Random(2)
    rows, labels = [], []
    for _ in range(2_000):
        a, b = draw.random() < 0.5, draw.random() < 0.5
        words = ["insult"] * a + ["group"] * b + [f"w{draw.randint(0, 20)}"]
        rows.append(np.unique([toxicity.bucket_of(w) for w in words]).astype(np.int64))
        labels.append(int(a and b))
    model = toxicity.fit(rows, np.array(labels))
    slots = [[model.slots[toxicity.bucket_of(w)] for w in t] for t in (["insult"], ["group"], ["insult", "group"])]
    chances = toxicity.sigmoid(model.margin(*toxicity._layout([np.array(s) for s in slots])))
    assert chances[0] < 0.5 and chances[1] < 0.5 and chances[2] > 0.9


def test_toxicity_on_held_out_rows_and_odd_input(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    unseen = docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(unseen, model).select("toxic", "predicted").toPandas()
    clean, bad = scored[scored.toxic == 0].predicted, scored[scored.toxic == 1].predicted
    assert clean.mean() < 0.01 and bad.mean() > 0.7
    odd = toxicity.score(odd_docs, model, names=("_a", "_b"))
    assert odd.columns == odd_docs.columns + ["_a", "_b"] and odd.count() == N_ODD
    assert toxicity.score(odd_docs, model).columns[-2:] == ["score", "predicted"]
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.train(no_docs, labels).slots == {}


# 4: packing


def unpacked(pieces):
    texts, windows = {}, {}
    for r in pieces.collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        texts.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    return texts, windows


def test_packing_is_an_exact_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame(
        [(10**6, "a <|endoftext|> b"), (10**6 + 1, "x" * 30_000), (10**6 + 2, None), (10**6 + 3, "　é\r\n😀 's")],
        docs.schema,
    )
    docs = docs.union(extra)
    pieces = packing.pack(docs, buffer_tokens=40_000)
    texts, windows = unpacked(pieces)
    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for doc_id, text in docs.collect():
        want = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        got = sorted(texts[doc_id], key=lambda p: p[0])
        assert np.concatenate([p[1] for p in got]).tolist() == want
        assert all(p[2] == len(want) for p in got)
    for own in windows.values():
        own.sort()
        ends = np.cumsum([length for _, length, _ in own])
        assert [o for o, _, _ in own] == [0, *ends[:-1]]
        assert ends[-1] == own[0][2] <= 2048 and ends[-1] & (ends[-1] - 1) == 0
    again = {tuple(r) for r in pieces.collect()}
    assert again == {tuple(r) for r in pieces.collect()}


def test_step_groups_are_balanced():
    lengths = [2048] * 90 + [1024] * 37 + [512] * 20 + [256] * 9
    steps = packing.balance(lengths, 65_536)
    loads = [sum(n for n, s in zip(lengths, steps) if s == k) for k in set(steps)]
    assert max(loads) - min(loads) <= 256


def test_packing_odd_input(odd_docs, no_docs):
    pieces = packing.pack(odd_docs)
    assert pieces.filter("doc_id = 5 and start = 0").count() == 2
    assert pieces.filter("doc_id is null").count() >= 1
    assert [r.length for r in pieces.filter("doc_id in (1, 2)").collect()] == [1, 1]
    assert packing.pack(no_docs).count() == 0


# 5: quality rules


def plain_repeats(words):
    grams, hit = {}, set()
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in grams.values():
        if len(places) > 1:
            hit.update(p + k for p in places for k in range(3))
    return len(hit)


def test_quality_measures_equal_plain_ones(spark, odd_docs, no_docs, monkeypatch):
    draw = random.Random(4)
    texts = [" ".join(draw.choices("abc", k=draw.randint(0, 30))) for _ in range(300)]
    texts += ["\n".join(draw.choices(["a b", " ", "", "# x", "é|é"], k=9)) for _ in range(50)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bits in (20, 4):  # with four bits of place, most texts take the exact branch
        monkeypatch.setattr(quality_rules, "_POSITION_BITS", bits)
        for r in quality_rules.judge(frame).collect():
            text = texts[r.doc_id]
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
            assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
            assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
            assert r.n_dup_lines == len(lines) - len(set(lines))
            assert r.n_repeat_words == plain_repeats(words)
    odd = quality_rules.judge(odd_docs)
    assert odd.count() == N_ODD and odd.filter("kept").count() == 0
    assert quality_rules.judge(no_docs).count() == 0


@pytest.mark.parametrize("kind", ["equal", "prose"])
def test_quality_rules_take_linear_time_under_a_filter(spark, kind):
    """50,000 words, filtered and aggregated: a word split anew for each word would take hours."""
    draw = random.Random(8)
    words = ["long"] * 50_000 if kind == "equal" else draw.choices(["the", *map(str, range(4_000))], k=50_000)
    frame = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    judged = quality_rules.judge(frame)
    assert judged.filter("kept").count() == (kind == "prose" and words.count("the") * 100 >= 2 * 50_000)
    assert judged.filter("not base_failed and n_words > 10").count() == (kind == "prose")
    assert judged.agg(F.sum("n_repeat_words")).first()[0] == plain_repeats(words)


# 6: near duplicates


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 100 >= 80 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc_id, _), x in zip(rows, label):
        least[x] = min(least.get(x, doc_id), doc_id)
    return {d: (len(s), least[x]) for (d, _), s, x in zip(rows, sets, label)}


def mutated(draw, words, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"z{draw.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    """Sizes across every edge of the bands, chains of copies, and a shared passage."""
    draw, rows = random.Random(6), []
    passage = [f"p{i}" for i in range(30)]
    for size in (1, 3, 5, 9, 14, 17, 19, 24, 33, 36, 45, 66, 70, 130, 140, 300):
        for _ in range(3):
            words = [f"v{draw.randrange(10**6)}" for _ in range(size)] + passage * (size > 60)
            rows.append(" ".join(words))
            for n in (0, 1, 1, 2, 3, 5):
                rows.append(mutated(draw, words, min(n, size // 4)))
            rows.append(" ".join(words + [f"y{i}" for i in range(size // 5)]))
    rows = list(enumerate(rows)) + [(9_000, None), (9_001, " "), (9_002, rows[5].upper())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    assert got == plain_components(rows)


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 2 3 4 5 None 7 8".split())
    assert jaccard.keep_one(no_docs).count() == 0
    assert jaccard.near_duplicates(odd_docs).count() == N_ODD
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_near_duplicates_remove_what_they_have_read(spark, steps, monkeypatch):
    seen, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda *tables: seen.append(steps()) or verify(*tables))
    rows = [(i, f"the same few words in a text of the group {i % 3} {'and more ' * (i % 3)}") for i in range(9)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert seen and not any(names & {"signatures", "shared-parts"} for names in seen)
    assert steps() == {"classes"}
    assert {r.doc_id: r.component_id for r in found.collect()} == {
        i: least for i, (_, least) in plain_components(rows).items()
    }


@pytest.mark.parametrize("size", [1, 2, 15, 16, 18, 31, 32, 40, 200, 1_000])
def test_linked_sets_share_a_signature(size):
    random_ = np.random.default_rng(size)
    for _ in range(30):
        common = random_.integers(0, 2**64, size, np.uint64)
        spare = random_.integers(0, 2**64, size // 4 + 1, np.uint64)
        cut = random_.integers(0, size // 9 + 1) if size >= 9 else 0
        grow = random_.integers(0, max(1, (size - cut) * 5 // 4 - size - cut + 1))
        a, b = np.unique(common), np.unique(np.concatenate([common[cut:], spare[:grow]]))
        both = len(np.intersect1d(a, b))
        if both * 100 >= 80 * (len(a) + len(b) - both):
            assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size
            x, y = sorted((jaccard.sketch(a), jaccard.sketch(b)), key=len)
            y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
            apart = np.bitwise_count((x ^ y).view(np.uint64)).sum()
            assert apart <= len(a) + len(b) - 2 * both


# 7: licences


def plain_words(text):
    """Words with their lines."""
    return [(w, i) for i, line in enumerate((text or "").split("\n")) for w in re.findall(r"[^\W_]+", line.lower())]


def plain_notices(text, templates, threshold):
    words = plain_words(text)
    pairs, windows = [(a[0], b[0]) for a, b in zip(words, words[1:])], []
    for name, template in templates.items():
        known = [w for w, _ in plain_words(template)]
        all_known = list(zip(known, known[1:]))
        wanted, longest = set(all_known), int(len(all_known) * (2 - threshold) / threshold + 1e-9)
        for i, first in enumerate(pairs):
            if first not in wanted:
                continue
            found = []
            for j in range(i, min(len(pairs), i + longest)):
                if pairs[j] not in wanted:
                    continue
                window = pairs[i : j + 1]
                shared = len(wanted.intersection(window))
                n = shared + sum(p not in wanted for p in window)
                dice = 2.0 * shared / (n + len(wanted))
                if dice >= threshold:
                    found.append((-dice, j, shared, n))
            if found:
                dice, j, shared, n = min(found)
                windows.append((-shared, dice, name, i, j, n))
    kept = []
    for w in sorted(windows):
        if all(w[4] < k[3] or k[4] < w[3] for k in kept):
            kept.append(w)
    return {
        (words[i][1], words[j + 1][1], i, name, -shared, n, round(-dice, 9)) for shared, dice, name, i, j, n in kept
    }


def found_notices(docs, *args):
    found = {}
    for r in licenses.scan(docs, *args).collect():
        row = (r.line_no, r.last_line, r.word_no, r.license, r.shared, r.bigrams, round(r.dice, 9))
        assert row not in found.setdefault(r.doc_id, set())
        found[r.doc_id].add(row)
    return found


@pytest.mark.parametrize("threshold", [licenses.THRESHOLD, 0.5])
def test_notices_equal_plain_windows(spark, odd_docs, no_docs, threshold):
    """Whole, damaged, cut, wrapped over lines, within lines, one after the other."""
    draw, texts, notices = random.Random(8), [], list(licenses.TEMPLATES.values())
    for text in notices:
        texts += [text, text.upper(), f"{text} and some more words follow", f"of the software {text}"]
        texts.append(re.sub(" ", lambda m: draw.choice([" ", " ", "\n# "]), text))
        texts += [mutated(draw, text.split(), n) for n in (1, 2, 4)]
        texts.append(" ".join(text.split()[: len(text.split()) * 3 // 4]))
    for _ in range(25):
        parts = [mutated(draw, draw.choice(notices).split(), draw.randint(0, 3)) for _ in range(draw.randint(2, 6))]
        texts.append(draw.choice([" ", "\n", " prose between "]).join(parts))
    short = [t for t in licenses.TEMPLATES.values() if len(t) < 90]
    pool = " ".join(short).split()
    texts += [" ".join(draw.choices(pool, k=draw.randint(2, 200))) for _ in range(25)]
    texts += [" ".join(draw.choices(short, k=60)), "", "license", "mit license " * 50]
    docs = spark.createDataFrame(
        [(i, f"prose of some words\n{x}\n\nend") for i, x in enumerate(texts)] * 2, "doc_id long, text string"
    )
    want = {i: plain_notices(f"prose of some words\n{x}\n\nend", licenses.TEMPLATES, threshold) for i, x in enumerate(texts)}
    assert found_notices(docs, licenses.TEMPLATES, threshold) == {i: w for i, w in want.items() if w}
    assert licenses.scan(odd_docs).count() == 0 and licenses.scan(no_docs).count() == 0
    assert licenses.scan(docs, {}).count() == 0 and licenses.scan(docs, {"one": "word", "none": ""}).count() == 0


def test_notices_wherever_they_stand(spark):
    """Wrapped over lines, at the end of a line, two in one line, many in a row, and a whole licence."""
    words = licenses.TEMPLATES["mit-permission"].split()
    texts = [
        "prose\n# " + " ".join(words[:12]) + "\n# " + " ".join(words[12:]) + "\nend",
        "Copyright 2020 Acme. Released under the MIT License.",
        licenses.TEMPLATES["apache-2.0-header"] + " and " * 20 + licenses.TEMPLATES["mit"],
        "prose\n" + "Released under the MIT License. " * 400,
        licenses.TEMPLATES["mit-text"],
        "licence permission software " * 2000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted((r.doc_id, r.line_no, r.last_line, r.license) for r in licenses.scan(docs).collect())
    assert [r for r in rows if r[0] != 3] == [
        (0, 1, 2, "mit-permission"),
        (1, 0, 0, "mit"),
        (2, 0, 0, "apache-2.0-header"),
        (2, 0, 0, "mit"),
        (4, 0, 0, "mit-text"),
    ]
    assert [r for r in rows if r[0] == 3] == [(3, 1, 1, "mit")] * 400


# 8: language


def test_languages_and_fusion(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pages = docs.filter(F.length("text") > 200).select(
        F.col("doc_id").alias("page_id"), F.lit("http://a.example/x").alias("url"),
        F.concat(F.lit("<html><p>"), "text", F.lit("</p>")).alias("html"), "lang",
    )
    found = langid.identify(pages.drop("lang"), docs).join(pages.select("page_id", "lang"), "page_id")
    assert found.filter("language = lang").count() / found.count() > 0.95
    empty = spark.createDataFrame(
        [(10**6, "http://de.example/", "<html lang=de>"), (10**6 + 1, None, None)] * 2,
        "page_id long, url string, html string",
    )
    german = pages.filter("lang = 'de'").withColumn("url", F.lit("http://de.example/y")).drop("lang")
    rows = langid.identify(german.union(empty), docs).filter("page_id = 1000000").collect()
    assert [r.language for r in rows] == ["de", "de"]  # no text: the host and markup decide
    assert langid.identify(empty.limit(0), docs).count() == 0


def test_training_reads_the_first_rows_by_hash(spark):
    """As many of each language as asked for, whatever the order and copies of the rows."""
    rows = [(i, f"text number {i} abc", "de" if i % 3 else "fr") for i in range(300)]
    rows += [(None, "null id", "de"), (1000, "other", "xx"), (1001, "none", None), (1002, None, "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, max_rows=20)
    assert np.array_equal(model, langid.train(docs.union(docs.filter("text is null")).repartition(7), max_rows=20))
    order = {r.doc_id: r.h for r in docs.filter("doc_id < 300").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    table = np.full(model.shape, 0.5)
    for language in ("de", "fr"):
        own = sorted((h, i) for i, h in order.items() if ("de" if i % 3 else "fr") == language)[:20]
        for _, i in own:
            np.add.at(table[langid.LANGUAGES.index(language)], langid.trigrams(rows[i][1]), 1)
    assert np.allclose(model, np.log(table / table.sum(1, keepdims=True)))
    assert len(set(langid.train(docs.limit(0)).ravel().round(9))) == 1


def test_fusion_equals_plain_sums(spark):
    """The chances of every page, worked out from the evidence in plain Python."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r for r in langid.identify(pages, docs).collect()}
    seen = langid.evidence(pages, langid.train(docs)).collect()
    languages, strength = langid.LANGUAGES, langid.STRENGTH
    sums = {}
    for r in seen:
        for group in ("all", ("host", r.host), ("domain", r.domain), ("suffix", r.suffix), ("declared", r.declared)):
            total = sums.setdefault(group, np.zeros(len(languages)))
            total += [r[f"t_{x}"] for x in languages]
    everywhere = sums["all"]
    share = (everywhere + 1) / (everywhere.sum() + len(languages))

    def smoothed(counts, own, parent):
        return (counts - own + strength * parent) / (counts.sum() - 1 + strength)

    def given(counts):
        return (counts + strength * counts.sum() / everywhere.sum()) / (everywhere + strength)

    for r in seen:
        own = np.array([r[f"t_{x}"] for x in languages])
        prior = smoothed(sums["host", r.host], own, smoothed(sums["domain", r.domain], own, share))
        logs = np.log(np.maximum(prior, 1e-9)) + np.log(np.maximum(own, 1e-30))
        logs += np.log(given(sums["declared", r.declared])) + np.log(given(sums["suffix", r.suffix]))
        chances = np.exp(logs - logs.max())
        assert abs(got[r.page_id].confidence - 1 / chances.sum()) < 1e-9
        assert chances[languages.index(got[r.page_id].language)] > 1 - 1e-9
    assert len(got) == len(seen)


# 9: mixing


def test_rates_meet_targets(spark, odd_docs, no_docs):
    words = {"a": "sun sea sand", "b": "snow ice frost", "c": "code bug test"}
    rows = [(i, f"{words['aab c'.replace(' ', '')[i % 4]]} number {i} " * (1 + i % 5)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame(
        [(i, "aabc"[i % 4]) for i in range(0, 400, 3)] + [(None, "a"), (5, "zzz")], "doc_id long, domain string"
    )
    model = mixing.train(docs, labelled, ("a", "b", "c"))
    targets = {"a": 0.2, "b": 0.5, "c": 0.3}
    mixed = mixing.mix(docs, model, targets).toPandas()
    tokens = [(mixed.rate * mixed.tokens * mixed[f"p{i}"]).sum() for i in range(3)]
    assert np.allclose(np.array(tokens) / mixed.tokens.sum(), [0.2, 0.5, 0.3], atol=2e-3)
    assert (mixed.rate >= 0).all() and abs(mixed.copies.mean() - mixed.rate.mean()) < 0.1
    least = mixing.mix(docs, model, targets, floor=F.lit(1.0)).toPandas()
    assert (least.rate >= 1).all() and (least.copies >= 1).all()
    odd = mixing.mix(odd_docs, model, targets)
    assert odd.agg(F.sum("n_rows")).first()[0] == N_ODD
    applied = mixing.apply_rates(odd_docs, odd.withColumn("copies", F.lit(2)))
    assert applied.columns == odd_docs.columns and applied.count() == 2 * N_ODD
    assert mixing.mix(no_docs, model, targets).count() == 0
    assert mixing.train(no_docs, labelled.limit(0), ("a", "b")).weights.count() == 0


def test_rare_domains_meet_their_own_targets(spark, monkeypatch):
    """Targets below a thousandth of all tokens count too; a gap that stays is named."""
    chances = {"prose": (0.999, 0.0009, 0.0001), "rough": (0.1, 0.899, 0.001), "toxic": (0.5, 0.3, 0.2)}
    rows = [(i, i, 1, 10, *chances[("prose", "prose", "rough", "toxic")[i % 4]]) for i in range(80)]
    table = spark.createDataFrame(
        rows, "doc_id long, text_key long, n_rows long, tokens long, p0 double, p1 double, p2 double"
    ).coalesce(1)
    monkeypatch.setattr(mixing, "posteriors", lambda docs, model: table)
    model = mixing.Classifier(tuple(chances), None, ())
    mixed = mixing.mix(None, model, dict(zip(chances, (0.99, 0.008, 0.002)))).toPandas()
    shares = [(mixed.rate * mixed.tokens * mixed[f"p{i}"]).sum() / mixed.tokens.sum() for i in range(3)]
    assert np.allclose(np.array(shares) / [0.99, 0.008, 0.002], 1, atol=1.1e-3)
    with pytest.warns(UserWarning, match="missed: .*toxic by"):
        mixing.mix(None, model, dict(zip(chances, (0.99, 0.008, 0.002))), floor=F.lit(1.0))


# 10: URLs


def test_urls_against_a_plain_version(spark):
    rules = (urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"))
    rows = [
        ("http://EXAMPLE.org/es/1", "example.org/es/", "block"),
        ("http://a.example.org/es", "org/", "allow"),
        ("https://notorg/es/", None, "allow"),
        ("https://www.spam.net/p/?utm_source=x&b=2&a=1#f", None, "block"),
        ("http://spam.net/p?a=1&b=2", None, "block"),
        ("http://spam.net/p", None, "allow"),
        ("mailto:x", None, "allow"),
        (None, None, "allow"),
        ("http://spam.net/p?a=1&b=2", None, "block"),
    ]
    pages = spark.createDataFrame([(i, u, 1) for i, (u, _, _) in enumerate(rows)], "page_id long, url string, host int")
    listed = spark.createDataFrame([("http://spam.net/p//?b=2&a=1",), (None,), ("x",)], "url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(pages, listed, rules).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(rows)}
    none = urls.filter_urls(pages, listed.limit(0), rules)
    assert none.filter("listed").count() == 0 and none.count() == len(rows)
    assert urls.filter_urls(pages.limit(0), listed, rules).count() == 0


def test_bloom_lets_every_listed_url_through(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_BLOCKS", 64)  # far too full: many false hits
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"))
    rows = urls.filter_urls(pages, pages.filter("page_id % 3 = 0"))
    assert rows.filter("listed <> (page_id % 3 = 0)").count() == 0
    assert rows.filter("possible and not listed").count() > 0


def test_crc_of_ids_is_that_of_their_bytes(spark):
    ids = struct.pack("<3I", 1, 70_000, 2**31)
    frame = spark.createDataFrame([(bytearray(ids),)], "ids binary")
    assert frame.select(F.crc32("ids")).first()[0] == zlib.crc32(ids)
