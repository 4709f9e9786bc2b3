"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Every text is taken whole, by paragraph (between blank lines) and by line, so that notices inside
other text are found. With a and b distinct bigrams, Dice is at most 2 min(a, b) / (a + b), so only
templates whose size lies within threshold / (2 - threshold) of a unit's come into question: each
template is listed under all sizes that can reach it, and a unit meets it by equality of size. The
list is as long as the templates, which are part of this package, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quaestor.llm.common import let, text_of
from quaestor.llm.licence_templates import TEMPLATES

THRESHOLD = 0.8
#: A broadcast template list may have this many bigrams at most.
MOST_BIGRAMS = 200_000

BLANK_LINES = r"\n[\x20\t\r]*\n\s*"


def bigrams(text: Column) -> Column:
    """Distinct hashes of two words in a row, of the lower-case text's runs of letters and digits."""
    split = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def pairs(ws: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(ws) - 2)
        hashes = F.transform(steps, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1)))
        return F.when(F.size(ws) > 1, hashes).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(let(split, pairs))


def template_rows(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, licence, own: bigrams of each template."""
    rows = [(i, licence, text) for i, (licence, _, text) in enumerate(templates)]
    frame = spark.createDataFrame(rows, "template int, licence string, text string")
    own = frame.select("template", "licence", bigrams(F.col("text")).alias("own"))
    if sum(len(t.split()) for _, _, t in templates) > MOST_BIGRAMS:
        raise ValueError("more templates than can be broadcast")
    return own


def admissible(sizes: Column, threshold: float) -> Column:
    """All unit sizes that can reach the threshold with a template of that size."""
    share = threshold / (2 - threshold)
    low = F.greatest(F.ceil(sizes * share - 1e-9).cast("int"), F.lit(1))
    return F.sequence(low, F.floor(sizes / share + 1e-9).cast("int"))


def units(docs: DataFrame) -> DataFrame:
    """doc_id, line, hashes: each line with its number from 0, and paragraphs and whole texts, whose
    line is -1 and -2."""
    lines = F.transform(F.split(text_of(), "\n"), lambda t, i: F.struct(i.alias("line"), t.alias("text")))
    parts = F.split(text_of(), BLANK_LINES)
    paragraphs = F.when(F.size(parts) > 1, F.transform(parts, lambda t: F.struct(F.lit(-1).alias("line"), t.alias("text"))))
    whole = F.array(F.struct(F.lit(-2).alias("line"), text_of().alias("text")))
    none = F.array().cast("array<struct<line:int,text:string>>")
    every = F.concat(lines, F.coalesce(paragraphs, none), whole)
    rows = docs.select("doc_id", F.explode_outer(every).alias("unit"))
    return rows.select("doc_id", "unit.line", bigrams(F.col("unit.text")).alias("hashes"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, licence, dice, line: the best match of each licence that a document states, and the
    first line that matches by itself, from 0 (null if only more lines together do).

    Null and empty texts and units of less than two words state nothing. Rows that share an id
    count as one document; a null id is an id of its own. Other columns are ignored.
    """
    known = template_rows(docs.sparkSession, templates)
    sizes = known.select("template", F.explode(admissible(F.size("own"), threshold)).alias("n"))
    sized = units(docs).withColumn("n", F.size("hashes"))
    near = sized.join(F.broadcast(sizes), "n").join(F.broadcast(known), "template")
    both = F.size(F.array_intersect("hashes", "own"))
    dice = 2 * both / (F.col("n") + F.size("own"))
    return (
        near.withColumn("dice", dice).filter(F.col("dice") >= threshold - 1e-9)
        .groupBy("doc_id", "licence")
        .agg(F.max("dice").alias("dice"), F.min(F.when(F.col("line") >= 0, F.col("line"))).alias("line"))
        .withColumn("line", F.col("line").cast("long"))
    )
