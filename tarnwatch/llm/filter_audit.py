"""Audit of filters that run one after another: what each removes, in every order.

Each document becomes a mask with a bit for every filter it fails. Documents are counted per part and mask (a *cell*), with
those that are good and those that are toxic. A recursive CTE then enumerates the orders: it starts from the empty
prefix and extends every prefix by each unused letter, carrying the applied bits and joining the part's cells; each
level of the recursion emits the metrics of its step. With five filters that is 325 prefixes per part; orders share
the rows of their prefixes, and only the last join spells out all 120 orders.

The only filter that needs other documents is `E`, copies of an earlier text. Texts are compared by their SHA-256. Rows are
counted by text, part and label first, with the least doc_id and how many rows carry it, so that a text which is a
third of all rows is a handful of rows per task before it is shuffled.

Only DataFrame and SQL functions; no Python workers.

Defined results: a NULL text is empty (it fails A, and E if another empty text has a smaller doc_id); a row without a doc_id is no
copy, as no id is smaller, and makes no other one a copy; rows that repeat the least doc_id of their text are no copies;
a document is good (toxic) if any of its label rows says so; a NULL lang is the part `''`; an empty table gives no rows.
Extra columns are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, load, materialise
from .registry import register

LETTERS = "ABCDE"
COPY = "E"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SIGNS = 100, 80, 10, "#$%&*|"


def text_masks(text) -> Column:
    """Bits 0 to 3 for the filters A to D, which look at one text alone."""
    text = F.coalesce(text, F.lit(""))
    # One blank for every white space, so that splitting is by a plain character.
    words = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")
    blank = F.lit("")

    def of(words):
        n, kinds = F.size(F.filter(words, lambda w: w != blank)), F.size(F.array_remove(F.array_distinct(words), ""))
        return F.when(n < LEAST_WORDS, 1).otherwise(0) + F.when(kinds * 100 < n * LEAST_DISTINCT, 2).otherwise(0)

    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    signs = F.length(text) - F.length(F.translate(text, SIGNS, ""))
    own = F.when(upper * 100 > F.length(text) * MOST_UPPER, 4).otherwise(0) + F.when(signs > 0, 8).otherwise(0)
    return of(words) + own


def cells(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and mask of failed filters."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), part.alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("name"), text_masks(F.col("text")).cast("int").alias("own"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, F.col("id") == F.col("_id"), "left").drop("_id").fillna(0, ["good", "toxic"])
    # Rows of a document that repeats are one row with a number; then the rows of a text in a part, whose own bits agree.
    same = ["name", "part", "own", "good", "toxic"]
    rows = rows.groupBy("id", *same).agg(F.count(F.lit(1)).alias("n"))
    with_id = F.col("id").isNotNull()
    groups = rows.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.when(with_id, F.struct("id", "n"))).alias("first"), F.sum(F.when(with_id, 0).otherwise(F.col("n"))).alias("nameless"))
    groups = materialise(groups.select(*same, "n", "nameless", F.col("first.id").alias("id"), F.col("first.n").alias("n_first")), "texts")
    least = groups.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("_least"))
    groups = groups.join(least, F.col("name") == F.col("_name"))
    stays = F.col("nameless") + F.when(F.col("id") == F.col("_least"), F.col("n_first")).otherwise(0)
    copy = 1 << LETTERS.index(COPY)
    both = F.explode(F.array(F.struct(F.col("own").alias("mask"), stays.alias("c")), F.struct((F.col("own") + copy).alias("mask"), (F.col("n") - stays).alias("c"))))
    out = groups.select("part", "good", "toxic", both.alias("x")).groupBy("part", "x.mask")
    count = lambda c: F.sum(c).cast("long")
    return out.agg(count("x.c").alias("n"), count(F.col("x.c") * F.col("good")).alias("good"), count(F.col("x.c") * F.col("toxic")).alias("toxic")).filter("n > 0")


#: Levels emit the metrics of their step. `failed` are the part's cells (mask, n, good, toxic), at most 2^5 of them;
#: an aggregate cannot stand in a recursion, so a part's cells are joined as one row and summed by a fold.
WALK = """
WITH RECURSIVE letters AS (SELECT * FROM VALUES {letters} AS t(letter, bit)),
walk(part, prefix, applied, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT w.part, concat(w.prefix, l.letter), w.applied + l.bit, l.letter,
         aggregate(c.failed, 0L, (s, x) -> s + if((x.mask & (w.applied + l.bit)) = 0, x.n, 0L)),
         aggregate(c.failed, 0L, (s, x) -> s + if((x.mask & w.applied) = 0 AND (x.mask & l.bit) > 0, x.n, 0L)),
         aggregate(c.failed, 0L, (s, x) -> s + if((x.mask & w.applied) > 0 AND (x.mask & l.bit) > 0, x.n, 0L)),
         aggregate(c.failed, 0L, (s, x) -> s + if(x.mask = l.bit, x.n, 0L)),
         aggregate(c.failed, 0L, (s, x) -> s + if((x.mask & w.applied) = 0 AND (x.mask & l.bit) > 0, x.good, 0L)),
         aggregate(c.failed, 0L, (s, x) -> s + if((x.mask & w.applied) = 0 AND (x.mask & l.bit) > 0, x.toxic, 0L))
  FROM walk w JOIN letters l ON (w.applied & l.bit) = 0 JOIN {cells} c ON c.part = w.part)
SELECT * FROM walk WHERE prefix <> ''
"""
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def steps(spark: SparkSession, counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, prefix, letter, metrics) for every prefix of every order, from cells (part, mask, n, good, toxic)."""
    failed = materialise(counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("failed")), "cells")  # 2^letters per part
    values = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))
    held = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")  # parts are as many as there are; levels are as many as letters
    try:
        return materialise(spark.sql(WALK.format(letters=values, cells="{failed}"), failed=failed), "walk")
    finally:
        spark.conf.unset(ROW_LIMIT) if held is None else spark.conf.set(ROW_LIMIT, held)


def audit(spark: SparkSession, counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step."""
    walk = steps(spark, counted, letters)
    orders = walk.filter(F.length("prefix") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    at = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    at = at.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    out = at.join(walk, ["part", "prefix"])
    total = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    metrics = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return out.join(total, ["part", "letter"]).select("part", "filter_order", "step", *metrics, "shapley")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (
  SELECT part,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM f),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
o AS (
  SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order
  FROM l a, l b, l x, l y, l z WHERE a.bit | b.bit | x.bit | y.bit | z.bit = 31),
s AS (
  SELECT filter_order, step, l.letter, l.bit,
         (SELECT coalesce(sum(e.bit), 0) FROM l e WHERE instr(filter_order, e.letter) < step)::BIGINT AS applied
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) k, l WHERE substr(filter_order, step, 1) = l.letter),
r AS (
  SELECT part, filter_order, step::INTEGER AS step, letter,
         coalesce(sum(n) FILTER (mask & (applied + bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & applied = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & applied > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & applied = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & applied = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""


@register("op13_filter_audit", SQL)
def op13_filter_audit(spark, sf_dir):
    """Five filters in all 120 orders, per language: what each step keeps, removes and finds removed already."""
    counted = cells(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), F.coalesce("lang", F.lit("")))
    return audit(spark, counted)
