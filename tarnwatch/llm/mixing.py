"""Mixing sources to target weights by capped water-filling.

Every source gets its weight's share of the total budget; a source whose share exceeds `max_epochs` times its size is
clamped there, and what it leaves is shared again among the others by weight, until none is above. A source's factor
(target over size) is then sampled as whole repetitions of every document plus one seeded fractional repetition:
documents in the order of a seeded hash until the target is filled, the last of them in part.

Only DataFrame functions. Documents of one source are never sorted together: running sums go over hash buckets of the
source first, and rows are ordered only inside the one bucket per source in which the fraction ends.

Defined results: a NULL or empty text has size 0 and takes 0; a NULL source is a source of its own, ordered last;
repeated rows are documents of their own; an empty table gives an empty mix; extra columns stay in `materialise_mix`.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, materialise, word_count
from .registry import register

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
HEX_DIGITS = 3  # 4,096 buckets of the seeded order per source


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) by water-filling, from (source, source_size).

    Sources ordered by the level at which they reach their cap: when the first k are clamped, the level of the rest is
    (budget - clamped caps) / remaining weight. The final level is that of the smallest k whose next source is not
    above its cap; that is where repeated clamping and sharing stops. One row per source, so the windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * float(max_epochs))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns({
        "_clamped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_left": F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        "_budget": F.sum("source_size").over(whole) * float(share),
    })
    s = s.withColumn("_level", (F.col("_budget") - F.col("_clamped")) / F.col("_left"))
    # Sources whose ratio is at or below the level found for them are clamped; the level of the first that is not holds for the rest.
    s = s.withColumn("_level", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "source", "_level"))).over(whole)["_level"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, share: float = 1.0, seed: int = 7) -> DataFrame:
    """Every row of `docs` with `size`, `source_size`, `target`, `copies` (whole) and `taken` (words the mix takes).

    These five take the place of columns of `docs` with the same names; `materialise_mix` leaves all columns as they are.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    # A NULL source is named by its own flag, so that groups, windows and joins share one partitioning.
    cell = ["__null", "__name", "__bucket"]
    sized = docs.select("*", word_count(F.col("text")).alias("__size"), key.alias("__key"), F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__name"))
    sized = sized.withColumn("__bucket", F.substring("__key", 1, HEX_DIGITS))
    cells = materialise(sized.groupBy(*cell).agg(F.sum("__size").alias("__cell")), "cells")
    sizes = cells.groupBy("__null", "__name").agg(F.sum("__cell").alias("source_size"))
    sizes = sizes.select("source_size", F.when(~F.col("__null"), F.col("__name")).alias("source"))
    targets = source_targets(sizes, weights, max_epochs, share).withColumn(
        "__whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    # Words still to take after the whole repetitions.
    targets = targets.withColumn("__rest", F.round(F.col("target") - F.col("__whole") * F.col("source_size")).cast("long"))
    targets = targets.select(F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__name"), "source_size", "target", "__whole", "__rest")
    upto = Window.partitionBy("__null", "__name").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__start", F.coalesce(F.sum("__cell").over(upto), F.lit(0))).join(targets, ["__null", "__name"])
    # Only inside a cell, one of thousands per source, rows are put in order.
    inner = Window.partitionBy(*cell).orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__inner", F.coalesce(F.sum("__size").over(inner), F.lit(0))).join(cells.drop("__cell"), cell)
    both = placed.withColumn("__extra", F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__rest") - F.col("__start") - F.col("__inner"))))
    part = F.when((F.col("__size") > 0) & (F.col("__extra") * 2 >= F.col("__size")), 1).otherwise(0)
    return both.select(
        *[F.col(c) for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")], F.col("__size").alias("size"),
        "source_size", "target", (F.col("__whole") * F.col("__size") + F.col("__extra")).alias("taken"), (F.col("__whole") + part).cast("int").alias("copies"))


def materialise_mix(docs: DataFrame, **kwargs) -> DataFrame:
    """The mixed rows themselves, with the columns of `docs`: each document `copies` times, part of one rounded."""
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    mixed = mix(whole, **kwargs).filter("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 3.0::DOUBLE AS cap FROM src),
levels AS (
  SELECT *, cap / w AS ratio,
    ((SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(w) FROM weighted) - coalesce(sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
  FROM weighted),
lv AS (SELECT arg_min(lev, ratio) AS level FROM levels WHERE ratio > lev),
targets AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM levels, lv),
run AS (
  SELECT s.*, t.source_size, t.target, floor(t.target / t.source_size)::BIGINT AS whole,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target - whole * source_size)::BIGINT - before)))::BIGINT AS taken,
       (whole + CASE WHEN size > 0 AND 2 * greatest(0, least(size, round(target - whole * source_size)::BIGINT - before)) >= size THEN 1 ELSE 0 END)::INTEGER AS copies
FROM run
"""


@register("op2_mixing", SQL)
def op2_mixing(spark, sf_dir):
    """All documents mixed: sizes, targets and the words taken of each."""
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
