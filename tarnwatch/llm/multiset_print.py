"""Homomorphic multiset fingerprints of texts: wide vectors hashed from paragraphs, summed modulo powers of two.

A text is the multiset of its parts: lines, and within a line its sentences (so that one-line texts have parts too).
Every part is hashed to a vector of `LANES` bytes; the fingerprint adds the vectors lane by lane modulo 2^31 (2^30 in
every second lane) and counts the parts. Sums commute, so the order of parts does not matter; adding or subtracting the vectors of
parts inserts or deletes them without the rest of the text. Unrelated parts have independent vectors, so the squared
distance of two fingerprints estimates how many parts differ, whatever the length of the texts: that is `likeness`. The
sums of n parts, less their mean, spread by 74 * sqrt(n), so they do not come near the modulus in any text.

Two lanes with a guard bit each travel in one long, so a lane-wise modular sum is one addition and a mask.
Only DataFrame functions.

Defined results: a NULL text is the empty text; empty texts have the all-zero fingerprint and likeness 1 among
themselves; with one document the next document is itself; repeated rows get equal results. Rows with a NULL doc_id
follow the last document, so the first one comes after each of them.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, materialise, text_bytes
from .registry import register

HASHES = 8  # hashes per part, each of eight bytes
LANES = 8 * HASHES
# A long holds two lanes 32 bits apart: one of 31 bits, the upper of 30, each with a guard bit above it.
BITS = (31, 30)
BYTES = 0x000000FF000000FF  # the bytes that every fourth byte of a hash adds to the lanes
MASK = 0x3FFFFFFF7FFFFFFF
GUARD = 0x4000000080000000


def parts(text) -> Column:
    """Lines, cut further after sentence ends that a blank follows; the pieces together are the text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=\n)|(?<=[.!?])(?= )"), lambda p: p != "")


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column: [count of parts, lanes...] as longs, four longs per hash."""
    inner = [f"_{name}{k}" for k in range(HASHES)]
    df = df.withColumn(f"_{name}", F.transform(parts(F.col(text)), lambda p: F.xxhash64(p)))

    def again(k):
        return F.transform(F.col(f"_{name}"), lambda h: F.xxhash64(h, F.lit(k)))

    def total(column, shift):
        return F.aggregate(F.col(column), F.lit(0).cast("long"), lambda acc, h: (
            acc + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(BYTES).cast("long"))).bitwiseAND(F.lit(MASK).cast("long")))

    df = df.withColumns({c: again(k) for k, c in enumerate(inner)})
    longs = [total(c, shift) for c in inner for shift in (0, 8, 16, 24)]
    return df.withColumn(name, F.array(F.size(f"_{name}").cast("long"), *longs)).drop(f"_{name}", *inner)


def insert(fingerprint: Column, added: Column) -> Column:
    """Fingerprint after adding the parts of another fingerprint."""
    return F.zip_with(fingerprint, added, lambda a, b: (a + b).bitwiseAND(F.lit(MASK).cast("long")))


def delete(fingerprint: Column, removed: Column) -> Column:
    """Fingerprint after taking out the parts of another: guard bits lend to lanes that run below zero."""
    return F.zip_with(fingerprint, removed, lambda a, b: (a.bitwiseOR(F.lit(GUARD).cast("long")) - b).bitwiseAND(F.lit(MASK).cast("long")))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _centred(fingerprint: Column) -> Column:
    """Lane sums less the mean of as many random bytes, around zero modulo the lane's power of two."""
    n = F.element_at(fingerprint, 1).cast("double")
    longs = F.slice(fingerprint, 2, LANES // 2)

    def lanes(k):
        half = float(1 << BITS[k] - 1)
        return F.transform(longs, lambda x: F.pmod(
            F.shiftrightunsigned(x, 32 * k).bitwiseAND(F.lit((1 << BITS[k]) - 1).cast("long")).cast("double") - n * F.lit(127.5) + F.lit(half), F.lit(2 * half)) - F.lit(half))

    return F.concat(*[lanes(k) for k in range(2)])


def likeness(a: str, b: str) -> Column:
    """1 - |a-b|^2 / (|a|^2 + |b|^2), held to 0..1: about the share of parts in common; 1 for equal fingerprints.

    Takes the names of two fingerprint columns whose centred lanes are in columns `c<name>`.
    """
    ca, cb = F.col(f"c{a}"), F.col(f"c{b}")

    def square(v):
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)

    apart, total = square(F.zip_with(ca, cb, lambda x, y: x - y)), square(ca) + square(cb)
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - apart / total)))


def with_next(docs: DataFrame, per_bucket: int = 4 << 20) -> DataFrame:
    """(doc_id, text, a, next_text, b): a text, its fingerprint, and those of the document that follows in descending
    doc_id order, after the last the first.

    Texts are dealt once, by quantiles of doc_id; the neighbour comes from a window inside the quantile, and each
    quantile's last row takes the first text of the quantile below it. Rows of equal doc_id are ordered by text.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.filter("doc_id is not null")
    n = max(1, text_bytes(docs) // per_bucket)
    cuts = known.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    splits = [float("-inf"), *sorted({0.0, *map(float, cuts)}), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_id", outputCol="_b").transform(known.withColumn("_id", F.col("doc_id").cast("double")))
    placed = placed.select(F.col("_b").cast("int").alias("_b"), "doc_id", "text")
    w = Window.partitionBy("_b").orderBy(F.col("doc_id").desc(), F.col("text").desc())
    near = with_vector(placed, "text", "a").select("*", F.lead(F.struct("text", "a")).over(w).alias("_next"))
    # First text of each quantile in the order: one row per quantile, combined before the shuffle.
    heads = placed.groupBy("_b").agg(F.max_by("text", F.struct("doc_id", "text")).alias("text"))
    heads = with_vector(heads, "text", "a").select("_b", F.struct("text", "a").alias("_head"))
    below = Window.orderBy("_b")
    start = F.max_by("_head", "_b").over(Window.partitionBy())
    heads = materialise(heads.select("_b", F.coalesce(F.lag("_head").over(below), start).alias("_head"), start.alias("_start")), "heads")
    out = near.join(heads, "_b").select("doc_id", "text", "a", F.coalesce("_next", "_head").alias("_n"))
    loose = with_vector(docs.filter("doc_id is null"), "text", "a").join(heads.select("_start").limit(1), F.lit(True), "left")
    out = out.unionByName(loose.select("doc_id", "text", "a", F.coalesce("_start", F.struct("text", "a")).alias("_n")))
    return out.select("doc_id", "text", "a", F.col("_n.text").alias("next_text"), F.col("_n.a").alias("b"))


@register("op10_multiset_fingerprint")
def op10_multiset_fingerprint(spark, sf_dir):
    """Every text and its edited text fingerprinted; likeness to the edited text and to the next document."""
    docs = with_next(load(spark, sf_dir, "documents"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "a", "b")
    vec = with_vector(docs, "edited", "e").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    vec = vec.withColumns({f"c{x}": _centred(F.col(x)) for x in "aeb"})
    near = {f"near_{name}": likeness("a", x) for name, x in (("edited", "e"), ("next", "b"))}
    return vec.withColumns(near).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), *near)
