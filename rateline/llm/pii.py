"""Personal data: patterned identifiers, and the terms that give them away.

Identifiers (e-mail, IP, card, phone) are found by patterns. Each one found is
a protected entity. The words around its mentions are counted over the corpus,
and a term's disclosure is its pointwise mutual information with the entity as
a share of the entity's own information:

    disclosure(t, e) = log2(n * p / n_e) / log2(n / n_e)

with n rows, n_e naming the entity, n_t holding the term, n_te doing both, and p the
lower confidence bound (Wilson's, of ``DEVIATIONS``) of n_te / n_t: few rows lower the
disclosure, none rules an entity out. Rarely named entities are judged again under a
coarser key, the domain of an e-mail, the network of an address, the first digits. In
every row that names an entity, each occurrence of a term above ``REMOVE`` is
removed and of one above ``GENERALISE`` becomes a category.

Everything is Column expressions, joins and grouped aggregation. Positions are
code points, taken from the lengths of the text between matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateline.llm.names import unused
from rateline.sources.workspace import materialize, scope

KINDS = ("email", "ip", "card", "phone", "term_general", "term_removed")
BASE = 4
GENERAL, REMOVED = 4, 5
PLACEHOLDERS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")

#: Possessive forms of the base patterns: the same matches, found in linear time.
#: An e-mail starts where a run of its characters starts, or where the last one ended.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Cheap tests that every match passes.
HINTS = ("contains(_text, '@')", "_digits", "_digits", "_digits and contains(_text, '+')")

#: Code points on either side of a mention whose words are proposed as terms. Words
#: farther off are proposed if they share two different texts with the entity.
REACH = 64
#: Standard deviations by which a share counts as less than it was seen.
DEVIATIONS = 1.0
GENERALISE, REMOVE = 0.75, 0.9
#: A word of three letters or more that is no part of an address.
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?![\p{N}@_%+-]|\.[\p{L}\p{N}@._%+-])"
#: What counts as a word of a row, in or beside an address too.
WORD = r"\p{L}{3,}+"

_SPAN = "struct<start:int,end:int,kind:int,value:string>"
#: Matches whose places are summed up in one go.
_RUN = 256


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


def _matches(text: str, pattern: str, kind: int) -> str:
    """SQL for the spans of all matches: an array of ``_SPAN`` by start.

    Runs of ``_RUN`` matches are placed by the lengths of the runs before them, so
    that a text of many matches is not copied once for each of them.
    """
    found, between = f"regexp_extract_all({text}, {_sql(pattern)}, 0)", f"split({text}, {_sql(pattern)}, -1)"
    return f"""
      transform(array({found}), m -> if(size(m) = 0, cast(array() as array<{_SPAN}>),
        transform(array(
          zip_with(m, slice({between}, 1, size(m)), (v, b) -> struct(length(b) as gap, length(v) as len, v as value))),
        w -> flatten(aggregate(
          transform(sequence(0, (size(w) - 1) div {_RUN}), k -> slice(w, k * {_RUN} + 1, {_RUN})),
          cast(struct(0, array()) as struct<at:int,runs:array<array<{_SPAN}>>>),
          (r, run) -> transform(array(aggregate(
            run,
            cast(struct(r.at, array()) as struct<at:int,found:array<{_SPAN}>>),
            (s, x) -> cast(struct(s.at + x.gap + x.len, concat(s.found, cast(array(
              struct(s.at + x.gap, s.at + x.gap + x.len, {kind}, x.value)) as array<{_SPAN}>)))
              as struct<at:int,found:array<{_SPAN}>>))),
            y -> cast(struct(y.at, concat(r.runs, array(y.found)))
              as struct<at:int,runs:array<array<{_SPAN}>>>))[0],
          r -> r.runs)))[0]))[0]"""


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


_LUHN = """aggregate(sequence(1, length(d)), 0, (s, i) -> s + if(i % 2 = 1,
    cast(substring(d, -i, 1) as int),
    cast(substring(d, -i, 1) as int) * 2 - if(substring(d, -i, 1) > '4', 9, 0))) % 10 = 0"""
_PART = "ltrim('0', p)"
#: SQL on a match ``x.value``; failing matches are dropped.
CHECKS = (
    "true",
    rf"forall(split(x.value, '[.]'), p -> length({_PART}) < 3 or (length({_PART}) = 3 and {_PART} <= '255'))",
    f"exists(array({_digits('x.value')}), d -> length(d) between 12 and 19 and {_LUHN})",
    f"length({_digits('x.value')}) between 9 and 15",
)


def base_spans() -> Column:
    """Spans of the identifiers in column ``_text``, by start and then kind."""
    parts = [
        f"if({hint}, filter({_matches('_text', pattern, kind)}, x -> {check}), cast(array() as array<{_SPAN}>))"
        for kind, (hint, pattern, check) in enumerate(zip(HINTS, PATTERNS, CHECKS))
    ]
    by_start = "(a, b) -> case when a.start <> b.start then a.start - b.start else a.kind - b.kind end"
    return F.expr(f"array_sort(concat({', '.join(parts)}), {by_start})")


#: SQL for the coarser key of an entity ``x``: domain, network of 256, issuer, area.
_POOL = f"""concat(x.kind, ':*', case x.kind
    when 0 then lower(substring_index(x.value, '@', -1))
    when 1 then substring_index(x.value, '.', 3)
    when 2 then left({_digits('x.value')}, 6)
    else left({_digits('x.value')}, 5) end)"""


def _company() -> Column:
    """For each span of ``_base``: the entity, its coarser key, and the terms around it.

    A word that the edge of the surroundings may have cut is left out.
    """
    before = f"substring(_text, greatest(x.start - {REACH}, 0) + 1, least(x.start, {REACH}))"
    after = f"substring(_text, x.end + 1, {REACH})"
    entity = f"concat(x.kind, ':', if(x.kind in (2, 3), {_digits('x.value')}, lower(x.value)))"
    left = f"""transform(
        filter({_matches('c.before', TERM, 0)}, t -> t.start > 0 or length(c.before) < {REACH}),
        t -> lower(t.value))"""
    right = f"""transform(
        filter({_matches('c.after', TERM, 0)}, t -> t.end < length(c.after) or length(c.after) < {REACH}),
        t -> lower(t.value))"""
    return F.expr(f"""
      transform(
        transform(_base, x -> struct(array({entity}, {_POOL}) as entities, {before} as before, {after} as after)),
        c -> struct(c.entities as entities, array_distinct(concat({left}, {right})) as terms))""")


def _words(text: str) -> str:
    """SQL for the different words of a text: what n_t and n_te count."""
    return f"array_distinct(transform(regexp_extract_all({text}, {_sql(WORD)}, 0), w -> lower(w)))"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base (array of start, end, kind), company, words and places, a row per row.

    ``words`` and ``places`` (of all terms) are empty where nothing is named. A null
    text is empty. Equal rows stay; other columns are left out.
    """
    places = f"transform({_matches('_text', TERM, 0)}, t -> struct(lower(t.value) as term, t.start as start, t.end as end))"
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
        .withColumn("_digits", F.expr("_text rlike '[0-9]'"))
        .withColumn("_base", base_spans())
        .select(
            "doc_id",
            F.xxhash64("_text").alias("text_key"),
            F.expr("transform(_base, x -> struct(x.start as start, x.end as end, x.kind as kind))").alias("base"),
            _company().alias("company"),
            F.expr(f"if(size(_base) > 0, {_words('_text')}, cast(array() as array<string>))").alias("words"),
            F.expr(
                f"if(size(_base) > 0, {places}, cast(array() as array<struct<term:string,start:int,end:int>>))"
            ).alias("places"),
        )
    )


def _at_least(hits: str, rows: str) -> Column:
    """The lower end of Wilson's interval of the share ``hits`` / ``rows``; under one."""
    k, n, z = F.col(hits).cast("double"), F.col(rows).cast("double"), DEVIATIONS
    spread = z * F.sqrt(4 * k * (n - k) / n + z * z)
    return (2 * k + z * z - spread) / (2 * (n + z * z))


def _marked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text_key, kinds (term to kind) of rows with terms to generalise or remove: a table."""
    rows, pair = ["doc_id", "text_key"], ["entity", "term"]
    entities = F.explode(F.array_distinct(F.flatten("company.entities"))).alias("entity")
    shared = found.select(*rows, entities, "words").select(*rows, "entity", F.explode("words").alias("term"))
    near = (
        found.select(F.explode("company").alias("c"))
        .select(F.explode("c.entities").alias("entity"), "c.terms")
        .select("entity", F.explode("terms").alias("term")).distinct()
    )
    together = (
        shared.groupBy(*pair)
        .agg(F.count("*").alias("n_te"), (F.min("text_key") != F.max("text_key")).alias("often"))
        .join(near.withColumn("near", F.lit(True)), pair, "left")
        .filter("often or near")
    )
    naming = found.select(entities).groupBy("entity").agg(F.count("*").alias("n_e"))
    candidates = materialize(together.join(naming, "entity").drop("often", "near"), "pii-pairs")
    # One pass over all words; each task counts before anything is shuffled.
    holding = (
        docs.select(F.explode(F.expr(_words("text"))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("n_t"))
    )
    total = docs.agg(F.count("*").alias("n"))
    judged = (
        candidates.join(holding, "term")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("bits", F.log2(F.col("n") / F.col("n_e")))
        .withColumn("disclosed", F.log2(_at_least("n_te", "n_t") * F.col("n") / F.col("n_e")))
        # Not divided by the bits: what every row names has none.
        .filter(F.col("disclosed") >= GENERALISE * F.col("bits"))
        .select(
            *pair,
            F.when(F.col("disclosed") >= REMOVE * F.col("bits"), F.lit(REMOVED))
            .otherwise(F.lit(GENERAL)).alias("kind"),
        )
    )
    # A table, so that the words of all rows are not shuffled where it is small.
    marked = (
        shared.join(materialize(judged, "pii-judged"), pair)
        .groupBy(*rows, "term").agg(F.max("kind").alias("kind"))
        .groupBy(*rows).agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    )
    return materialize(marked, "pii-marked", keep=True)


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text_key, terms (array of start, end, kind to generalise or remove)."""
    rows = ["doc_id", "text_key"]
    with scope(found.sparkSession):
        marked = _marked(docs, found)
    same = F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.text_key") == F.col("m.text_key"))
    return (
        found.filter(F.size("base") > 0).dropDuplicates(rows).alias("f").join(marked.alias("m"), same)
        .select("f.doc_id", "f.text_key", F.expr("""
          transform(filter(f.places, p -> map_contains_key(m.kinds, p.term)),
                    p -> struct(p.start as start, p.end as end, m.kinds[p.term] as kind))""").alias("terms"))
    )


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base and terms (arrays of start, end, kind), a row per row."""
    found = materialize(find(docs), "pii-found")
    terms = disclosing_terms(docs.select("doc_id", "text"), found)
    left, right = found.select("doc_id", "text_key", "base").alias("f"), terms.alias("t")
    same = F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("f.text_key") == F.col("t.text_key"))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    return left.join(right, same, "left").select(
        "f.doc_id", "f.text_key", "f.base", F.coalesce("t.terms", none).alias("terms")
    )


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, by start and then kind."""
    kinds = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start, s.kind, s.end)))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start, s.end)), ","
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with every span of ``text`` replaced by its placeholder.

    Where spans overlap, the later one covers only what the earlier left. A null
    text stays null; texts without spans are untouched. ``docs`` must have the
    columns doc_id and text; other columns, whatever their names, stay.
    """
    id_, key, all_spans = unused(docs.columns, "_id", "_key", "_spans")
    known = spans(docs).select(
        F.col("doc_id").alias(id_),
        F.col("text_key").alias(key),
        F.concat("base", "terms").alias(all_spans),
    ).filter(F.size(all_spans) > 0).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (
        F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key)
    )
    marks = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
    clean = F.expr(f"""
      if({all_spans} is null, text, transform(array(
        aggregate(
          array_sort(transform({all_spans}, s -> struct(s.start as start, s.kind as kind, s.end as end))),
          cast(struct(0, array()) as struct<at:int,kept:array<string>>),
          (a, s) -> if(s.end <= a.at, a, cast(struct(s.end,
            concat(a.kept, array(substring(text, a.at + 1, greatest(s.start - a.at, 0)),
                                 array({marks})[s.kind]))) as struct<at:int,kept:array<string>>)))),
        a -> concat(array_join(a.kept, ''), substring(text, a.at + 1)))[0])""")
    names = docs.columns
    return docs.join(known, same, "left").withColumn("text", clean).select(*[f"`{n}`" for n in names])
