"""Exact top-k search by tiled matrix products.

Vectors are packed into shards and queries into blocks (`vectors`), both written once. The product of all queries with all
vectors is cut into *cells* of at most about `CELL` queries by `CELL` vectors; a cell is the work of one task. It holds its
queries and streams its shards: each tile, a strip of a query block by a shard, is one matrix product, from which the best k
per query are selected partially, with the tile's equal scores ordered by vec_id. A cell keeps one running list per query.
The lists of the cells that share a query block are merged in a tree, `FAN` lists at a time, until one is left.

Every block of queries meets every shard (queries are a stated set against all rows). What is shuffled is the vectors once
per `CELL` queries and the queries once per `CELL` vectors; no pair leaves a task but the best k of a cell.

Scores are integer inner products of floor(scale * x), exact. Equal scores are ordered by vec_id.

Defined results: a vector that is NULL or holds a NULL or a non-finite component takes no part, neither as a query; vectors are
compared with those of their own length (an empty one scores 0); rows that carry the query's vec_id are its own and are no
candidates; a row without a vec_id asks nothing and comes after all others of its score; repeated candidates are rows
of their own; a query that repeats in vec_id and vector asks once, the same vec_id with another vector asks on its own;
an empty table gives no rows; products beyond 63 bits wrap as those of long numbers do. Extra columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import load, materialise, prepare, tidied
from .registry import register

K, SCALE = 10, 1024
FAN = 16  # lists merged at once

PACKED = "dim int, part long, n int, ids binary, kinds binary, ints binary"
LISTS = "part long, cell int, n int, asking binary, scores binary, kinds binary, ids binary"


def pack(table: DataFrame, scale: int) -> DataFrame:
    """Blocks of the valid vectors of (vec_id, embedding); a block holds one dimension, in order of vec_id."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(d):
            nonlocal made
            ids, kinds, z = (np.concatenate(x) for x in zip(*held.pop(d)))
            for lo in range(0, len(ids), V.BLOCK):
                i, kind, m = (x[lo : lo + V.BLOCK] for x in (ids, kinds, z))
                order = V.by_name(i, kind)
                made += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d], pa.int32()), pa.array([(task << 32) + made]), pa.array([len(i)], pa.int32()),
                     *[pa.array([x], pa.binary()) for x in (i[order].tobytes(), kind[order].tobytes(), V.packed(m[order]))]],
                    names=["dim", "part", "n", "ids", "kinds", "ints"])

        for batch in batches:
            ids, kinds = V.names(batch.column("vec_id"))
            for d, rows, z in V.matrices(batch.column("embedding"), scale):
                held.setdefault(d, []).append((ids[rows], kinds[rows], z))
                if sum(len(x[0]) for x in held[d]) >= V.BLOCK:
                    yield from block(d)
            if len(held) > 64:  # many dimensions: none waits for more
                for d in list(held):
                    yield from block(d)
        for d in list(held):
            yield from block(d)

    return table.select("vec_id", "embedding").mapInArrow(tidied(run), PACKED)


def _blocks(batch: pa.RecordBatch):
    return zip(*[batch.column(c).to_pylist() for c in ("kind", "dim", "row", "cell", "part", "n", "ids", "kinds", "ints")])


def _cells(k: int):
    """From the rows of a cell, query blocks first: the running lists of its queries."""

    def run(batches):
        now, asked = None, []

        def lists():
            for part, cell, own, _, best in asked:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part]), pa.array([cell], pa.int32()), pa.array([len(own)], pa.int32()),
                     *[pa.array([x.tobytes()], pa.binary()) for x in (own, best.scores, best.kinds, best.ids)]],
                    names=["part", "cell", "n", "asking", "scores", "kinds", "ids"])

        for batch in batches:
            for kind, dim, row, cell, part, n, ids, kinds, ints in _blocks(batch):
                if (dim, row, cell) != now:
                    yield from lists()
                    now, asked = (dim, row, cell), []
                ids, kinds, z = np.frombuffer(ids, np.int64), np.frombuffer(kinds, np.int8), V.unpacked(ints, n, dim)
                if kind == 0:
                    asked.append((part, cell, ids, z, V.Lists(n, k)))
                    continue
                for _, _, own, q, best in asked:
                    for lo in range(0, len(own), V.STRIP):
                        at = slice(lo, min(lo + V.STRIP, len(own)))
                        _tile(own[at], q[at], ids, kinds, z, best, at, k)
        yield from lists()

    return run


def _tile(own, q, ids, kinds, z, best, at, k) -> None:
    """Selects from one tile and merges into the running lists of its queries."""
    scores = V.products(q, z)
    V.hide_own(scores, own, ids, kinds)
    row, place, col = V.first_of(scores, k)
    found = V.Lists(len(own), k)
    found.scores[row, place] = scores[row, col].astype(np.int64)
    found.kinds[row, place] = kinds[col]
    found.ids[row, place] = ids[col]
    best.merged(found, at)


def _merge(k: int):
    """One list from those of a query block that meet in a branch of the tree."""

    def run(batches):
        now, held = None, None
        for batch in batches:
            for part, cell, n, asking, *lists in zip(*[batch.column(c).to_pylist() for c in ("part", "cell", "n", "asking", "scores", "kinds", "ids")]):
                more = V.Lists.of(*lists, k)
                if now is not None and now[:2] == (part, cell):
                    held.merged(more)
                    continue
                if now is not None:
                    yield _row(now, held)
                now, held = (part, cell, n, asking), more
        if now is not None:
            yield _row(now, held)

    return run


def _row(head, best) -> pa.RecordBatch:
    part, cell, n, asking = head
    return pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([cell], pa.int32()), pa.array([n], pa.int32()), pa.array([asking], pa.binary()),
         *[pa.array([x.tobytes()], pa.binary()) for x in (best.scores, best.kinds, best.ids)]],
        names=["part", "cell", "n", "asking", "scores", "kinds", "ids"])


def _flat(k: int):
    def run(batches):
        for batch in batches:
            for asking, *lists in zip(*[batch.column(c).to_pylist() for c in ("asking", "scores", "kinds", "ids")]):
                best, asking = V.Lists.of(*lists, k), np.frombuffer(asking, np.int64)
                row, place = np.nonzero(best.kinds != V.NOTHING)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asking[row]), pa.array((place + 1).astype(np.int32)), pa.array(best.ids[row, place], mask=best.kinds[row, place] == V.NAMELESS),
                     pa.array(best.scores[row, place])], names=["query_id", "rank", "vec_id", "score"])

    return run


def search(table: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the first k rows of `table` for every row of `queries`; both have vec_id, embedding."""
    prepare(table.sparkSession)
    shards = materialise(pack(table, scale), "shards")
    asking = queries.filter("vec_id is not null").select("vec_id", "embedding").dropDuplicates()
    asking = materialise(pack(asking, scale), "query_blocks")
    across, down = (max(1, math.ceil((b.agg(F.sum("n")).first()[0] or 0) / V.CELL)) for b in (shards, asking))  # two numbers
    place = lambda parts, salt: F.pmod(F.xxhash64("part", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    fields = ["part", "n", "ids", "kinds", "ints"]
    left = asking.select(F.lit(0).alias("kind"), "dim", place(down, "row").alias("row"), every(across).alias("cell"), *fields)
    right = shards.select(F.lit(1).alias("kind"), "dim", every(down).alias("row"), place(across, "cell").alias("cell"), *fields)
    cells = left.unionByName(right).repartition(2 * across * down, "dim", "row", "cell").sortWithinPartitions("dim", "row", "cell", "kind", "part")
    lists = cells.mapInArrow(tidied(_cells(k)), LISTS)
    while across > 1:
        across = math.ceil(across / FAN)
        lists = lists.withColumn("cell", F.expr(f"cast(cell div {FAN} as int)")).repartition("part", "cell").sortWithinPartitions("part", "cell")
        lists = lists.mapInArrow(tidied(_merge(k)), LISTS)
    return lists.mapInArrow(tidied(_flat(k)), "query_id long, rank int, vec_id long, score long")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS z
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.z, c.z)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@register("op11_topk_search", SQL)
def op11_topk_search(spark, sf_dir):
    """The ten rows of highest integer inner product for every embedding whose vec_id is divisible by 100."""
    table = load(spark, sf_dir, "embeddings")
    return search(table, table.filter("vec_id % 100 = 0"))
