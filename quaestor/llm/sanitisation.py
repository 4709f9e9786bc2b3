"""PII by information-theoretic sanitisation.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers of the texts. How
strongly a term reveals an entity is estimated from the whole corpus: with N documents, n_c that hold
the entity, n_t that hold the term and n_ct that hold both, the term outside of personal data, the
pointwise mutual information log(N n_ct / (n_c n_t)) over the entity's information log(N / n_c) is the
share that is disclosed, 1 if the term never occurs without the entity. Terms from GENERALISE on are
replaced by their form, from REMOVE on they are removed, wherever in the corpus they stand. Terms need
SUPPORT documents with the entity, as one occurrence estimates nothing.

All positions come from the lengths of matches and of the gaps between them. Patterns start only
where a match can and never step back, so long runs cost no more than their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quaestor.llm.common import let, small, text_key, text_of, written

# The kinds in order, and what they look like. (?:(?<!x)|\G) is where a run of x
# begins or the last match ended; ++ and ?+ don't step back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}[\p{L}\p{N}]{2,}+"
# Around a term, which is the end of a run of letters and digits from its first letter on. The class
# has a letter beyond 16 bits, as Java looks behind by whole code points only if a pattern holds one.
BEFORE, AFTER = "(?<![\\p{L}\\p{N}\U00010000])\\p{N}*+(?:", r")(?![\p{L}\p{N}])"

SUPPORT = 3
GENERALISE = 0.75
REMOVE = 0.95
_BLOCK = 128


def running_totals(lengths: Column) -> Column:
    """Sums of a list's beginnings. Blocks are summed first: appending copies, which for one long
    list would take the square of its length."""

    def sums(xs: Column) -> Column:
        return F.aggregate(
            xs, F.array().cast("array<bigint>"),
            lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x)),
        )

    def joined(blocks: Column) -> Column:
        return let(
            sums(F.transform(blocks, lambda b: F.element_at(b, -1))),
            lambda ends: F.flatten(
                F.transform(
                    blocks,
                    lambda b, i: F.transform(b, lambda s: s + F.when(i > 0, F.get(ends, i - 1)).otherwise(0)),
                )
            ),
        )

    def totals(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(own), F.lit(_BLOCK))
        blocks = F.transform(starts, lambda i: sums(F.slice(own, i, _BLOCK)))
        return F.when(F.size(own) > 0, let(blocks, joined)).otherwise(F.array().cast("array<bigint>"))

    return let(lengths, totals)


def matches(text: Column, pattern: str | Column) -> Column:
    """start, end, value of each match, leftmost first, in code points."""

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.flatten(
            F.zip_with(
                F.slice(gaps, F.lit(1), F.size(hits)), hits,
                lambda g, h: F.array(F.length(g).cast("long"), F.length(h).cast("long")),
            )
        )
        return let(
            running_totals(lengths),
            lambda at: F.transform(
                hits,
                lambda h, i: F.struct(
                    F.get(at, 2 * i).alias("start"), F.get(at, 2 * i + 1).alias("end"), h.alias("value")
                ),
            ),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the check: every second from the right doubled, digit sums in all."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match is one of its kind."""
    if kind == "ip":
        return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """kind (its place in KINDS), start, end, value of everything personal, by kind, then start."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def of(place: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: holds(kind, m["value"]))
        if kind in NEEDED:
            found = F.when(F.contains(text, F.lit(NEEDED[kind])), found).otherwise(none)
        return F.transform(
            found,
            lambda m: F.struct(
                F.lit(place).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")
            ),
        )

    return F.concat(*[of(place, kind) for place, kind in enumerate(PATTERNS)])


def entity_of(span: Column) -> Column:
    """The entity that a base span names: its kind and value, however it is written."""
    value = span["value"]
    plain = F.when(span["kind"] == 0, F.lower(value)).when(span["kind"] == 1, value).otherwise(digits(value))
    return F.concat_ws(":", span["kind"], plain)


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of base spans, so that all else keeps its position."""

    def step(done: Column, s: Column) -> Column:
        start, end = F.greatest(s["start"], done["end"]), F.greatest(s["end"], done["end"])
        gap = F.substr(text, (done["end"] + 1).cast("int"), (start - done["end"]).cast("int"))
        return F.struct(
            end.alias("end"),
            F.concat(done["out"], F.array(gap, F.repeat(F.lit(" "), (end - start).cast("int")))).alias("out"),
        )

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    first = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("out"))
    rest = F.aggregate(
        by_start, first, step,
        lambda done: F.concat(F.array_join(done["out"], ""), F.substr(text, (done["end"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def terms_of(text: Column) -> Column:
    """Distinct lower-case terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key(text_of()).alias("doc_key"), text_of().alias("whole"))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, base spans with their entity, and the terms outside of them, of documents
    that hold personal data; a row a document."""
    # explode keeps the spans from being computed again in each later expression; explode_outer, as for
    # explode() the optimizer adds a filter that computes the list again, even below joins
    rows = keyed(docs).select("*", F.explode_outer(F.array(base_spans(F.col("whole")))).alias("spans"))
    spans = F.transform(
        "spans",
        lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), entity_of(s).alias("entity")
        ),
    )
    return rows.filter(F.size("spans") > 0).select(
        "doc_id", "doc_key", spans.alias("spans"), terms_of(blanked(F.col("whole"), F.col("spans"))).alias("terms")
    ).dropDuplicates(["doc_id", "doc_key"])


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """entity, term, disclosure: terms that reveal an entity, by counts over all documents.

    A disclosure of GENERALISE asks for n_t of at most n_c (N / n_c) ** (1 - GENERALISE), as n_ct is
    at most n_c; terms above it are left out before they are paired with entities.
    """
    place = ["doc_id", "doc_key"]
    named = found.select(*place, F.explode(F.array_distinct("spans.entity")).alias("entity"))
    often = written(named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")).filter(F.col("n_c") >= SUPPORT))
    total = docs.count()
    most = F.col("n_c") * F.pow(total / F.col("n_c"), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    owned = (
        named.join(small(often), "entity").withColumn("most", most).groupBy(*place)
        .agg(F.collect_list(F.struct("entity", "n_c", "most")).alias("entities"), F.max("most").alias("most"))
        .select(F.col("doc_id").alias("own_id"), F.col("doc_key").alias("own_key"), "entities", "most")
    )
    same = found["doc_id"].eqNullSafe(owned["own_id"]) & (found["doc_key"] == owned["own_key"])
    held = written(found.join(owned, same).select("terms", "entities", "most"))
    near = held.select("entities", "most", F.explode("terms").alias("term"))
    terms = small(written(near.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT).select("term")))
    counts = (
        docs.select(F.explode_outer(terms_of(text_of())).alias("term")).join(terms, "term")
        .groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    )
    limit = held.agg(F.max("most")).first()[0] or 0.0
    counts = small(written(counts.filter(F.col("n_t") <= limit)))
    paired = near.join(counts, "term").filter(F.col("n_t") <= F.col("most")).select(
        "term", "n_t", F.explode(F.filter("entities", lambda e: F.col("n_t") <= e["most"])).alias("e")
    )
    known = (
        paired.groupBy(F.col("e.entity").alias("entity"), "term")
        .agg(F.count(F.lit(1)).alias("n_ct"), F.max("e.n_c").alias("n_c"), F.max("n_t").alias("n_t"))
        .filter(F.col("n_ct") >= SUPPORT)
    )
    shared = F.log(F.lit(total) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    own = F.log(F.lit(total) / F.col("n_c"))
    return known.select(
        "entity", "term", F.when(own > 0, F.least(shared / own, F.lit(1.0))).otherwise(0.0).alias("disclosure")
    ).filter(F.col("disclosure") >= GENERALISE)


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, spans: kind, start, end and disclosure (null for the base) of documents that
    have any. Terms are looked for in every whole text, outside of base spans."""
    place = ["doc_id", "doc_key"]
    found = written(entities(docs))
    revealing = small(written(disclosures(docs, found).groupBy("term").agg(F.max("disclosure").alias("disclosure"))))
    # explode_outer as in entities()
    placed = keyed(docs).select(*place, "whole", F.explode_outer(F.array(base_spans(F.col("whole")))).alias("base"))
    words = F.array_distinct(F.regexp_extract_all(blanked(F.col("whole"), F.col("base")), F.lit(TERM), F.lit(0)))
    holding = small(written(
        placed.select(*place, F.explode_outer(words).alias("word")).withColumn("term", F.lower("word"))
        .join(revealing, "term").groupBy(F.col("doc_id").alias("holding_id"), F.col("doc_key").alias("holding_key"))
        .agg(F.array_join(F.collect_set("word"), "|").alias("words"))
    ))
    same = placed["doc_id"].eqNullSafe(holding["holding_id"]) & (placed["doc_key"] == holding["holding_key"])
    # only what a text holds is looked for, so that no other word needs a position
    pattern = F.concat(F.lit(BEFORE), "words", F.lit(AFTER))
    word = F.regexp_replace("m.value", r"^\p{N}+", "")
    hidden = (
        placed.join(holding, same)
        .select(*place, F.explode_outer(matches(blanked(F.col("whole"), F.col("base")), pattern)).alias("m"))
        .select(*place, F.lower(word).alias("term"), (F.col("m.end") - F.length(word)).alias("start"), F.col("m.end").alias("end"))
        .join(revealing, "term").distinct()
        .select(*place, F.lit(len(KINDS) - 1).alias("kind"), "start", "end", "disclosure")
    )
    base = found.select(*place, F.explode("spans").alias("s")).select(
        *place, "s.kind", "s.start", "s.end", F.lit(None).cast("double").alias("disclosure")
    )
    return (
        base.unionByName(hidden).groupBy(*place)
        .agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "disclosure"))).alias("spans"))
    )


def clean_text(text: Column, spans: Column) -> Column:
    """The text with base spans as their kind, terms as their form or gone. Of overlapping spans the
    first one stands for all it touches."""

    def label(s: Column, covered: Column) -> Column:
        name = F.when(s["kind"] == 0, "[email]").when(s["kind"] == 1, "[ip]").when(s["kind"] == 2, "[card]")
        name = name.when(s["kind"] == 3, "[phone]").when(s["disclosure"] >= REMOVE, "")
        return name.otherwise(F.when(covered.rlike("[0-9]"), "[code]").otherwise("[word]"))

    def step(done: Column, s: Column) -> Column:
        starts = s["start"] >= done["end"]
        gap = F.substr(text, (done["end"] + 1).cast("int"), (s["start"] - done["end"]).cast("int"))
        own = F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.struct(
            F.greatest(done["end"], s["end"]).alias("end"),
            F.when(starts, F.concat(done["out"], F.array(gap, label(s, own)))).otherwise(done["out"]).alias("out"),
        )

    by_start = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["disclosure"].alias("disclosure")))
    )
    first = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        by_start, first, step,
        lambda done: F.concat(F.array_join(done["out"], ""), F.substr(text, (done["end"] + 1).cast("int"), F.length(text))),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with `spans` (kind as place in KINDS, start, end, disclosure) and
    `sanitised_text`; starts are code points from 0, ends exclusive.

    Null and empty texts have no spans; a null text stays null. Rows that repeat an id and a text
    count as one document that holds an entity and come out alike. A null id is an id of its own. Columns
    of those names are replaced.
    """
    found = all_spans(docs).select(
        F.col("doc_id").alias("found_id"), F.col("doc_key").alias("found_key"), F.col("spans").alias("found_spans")
    )
    kept = docs.drop("spans", "sanitised_text")
    joined = kept.join(
        found, kept["doc_id"].eqNullSafe(found["found_id"]) & (text_key(text_of()) == found["found_key"]), "left"
    )
    spans = F.coalesce(
        found["found_spans"], F.array().cast("array<struct<kind:int,start:bigint,end:bigint,disclosure:double>>")
    )
    text = F.when(F.size(spans) > 0, clean_text(kept["text"], spans)).otherwise(kept["text"])
    return joined.select(*[kept[c] for c in kept.columns], spans.alias("spans"), text.alias("sanitised_text"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
