"""Hard negatives by a GNAT-style multiway hyperplane tree.

Every inner node has up to `WAYS` split points; a row goes to the nearest one (the hyperplanes between split points part the
space), and so on down to the leaves. For each split point i and each sibling subtree j the node stores the least and the
largest distance from the point to any row in the subtree, and the range of the rows' norms. Split points come from a
sample of at most `SAMPLE` rows, chosen by a hash (a documented bound: it shapes the tree, not the result). Every row of the
table is indexed, and the distance ranges are those of all rows.

What is asked of the tree is a window of inner products [lo, hi] around an anchor. With the norms of a subtree it becomes an
annulus of distances around the anchor, and with the anchor's distance to split point i an interval of distances to that
point. A sibling whose stored range does not meet the interval, for any split point, cannot hold a row in the window and is
eliminated. Leaves that remain are searched exactly, as matrix products of anchors and rows, so the result is exact.

An anchor asks four times: its home leaf for rows of its own label, which bounds its positives from below; all leaves that
this bound leaves for the positives; its home leaf for each positive's window, which raises the windows' lower ends; all
leaves that these windows leave for the negatives.

In Spark: rows are routed down the tree in Arrow batches and written as blocks by leaf. A leaf of more than `CELL` rows is
searched in several cells, and anchors that visit a leaf are dealt over cells too, so a leaf that holds a third of all rows
(copies cannot be parted by any tree) is shared by as many tasks. A cell returns the first few rows per anchor and window.

Scores are integer inner products of floor(scale * x); order is by score, highest first, then by vec_id, NULL last.

Defined results: rows with a NULL label, a NULL vector, or a NULL or non-finite component take no part; vectors are compared
with those of their own length; rows with the anchor's vec_id are its own, neither positives nor negatives; repeated rows are
rows of their own, but as anchors they ask once; a row without a vec_id is no anchor and comes last of its score; an
anchor without positives, and a positive without rows in its window (all with a negative score), give no rows; an empty
table gives no rows; vectors with a component of 2^20 or more are kept in a leaf that is never eliminated. Extra columns
are not read.
"""

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors as V
from .common import load, materialise, prepare, tidied
from .registry import register

SCALE = 256
SAMPLE, WAYS, LEVELS = 4096, 16, 2
POSITIVES, NEGATIVES = 5, 5
FROM, UPTO = 80, 100  # per cent of the positive's score
LARGE = 1 << 20  # components from here on are outside of the tree
OUTSIDE = -1
ANY = (-(1 << 62), 1 << 62)


@dataclass
class Node:
    points: np.ndarray
    children: list  # numbers of nodes, or ~number of a leaf
    least: np.ndarray = None  # [point, child]: range of distances; inverted where the child holds nothing
    most: np.ndarray = None
    norm_least: np.ndarray = None
    norm_most: np.ndarray = None


@dataclass
class Tree:
    nodes: list = field(default_factory=list)
    leaves: int = 1


def _distances(z: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, exact: components are below `LARGE`."""
    z, points = z.astype(np.float64), points.astype(np.float64)
    return (z * z).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (z @ points.T)


def _spread_points(sample: np.ndarray, ways: int, seed: int) -> np.ndarray:
    """Split points: of some rows drawn, one, then always the one farthest from those already taken."""
    rng = np.random.default_rng(seed)
    drawn = np.unique(sample[rng.permutation(len(sample))[: 3 * ways]], axis=0)
    taken = [0]
    far = _distances(drawn, drawn[:1])[:, 0]
    while len(taken) < min(ways, len(drawn)) and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, _distances(drawn, drawn[taken[-1]][None])[:, 0])
    return drawn[taken]


def grow(sample: np.ndarray, ways: int = WAYS, levels: int = LEVELS) -> Tree:
    """The tree's split points from a sample; ranges come later, from all rows."""
    tree = Tree(leaves=0)

    def node(rows, level):
        points = _spread_points(rows, ways, len(tree.nodes))
        own = Node(points, [])
        tree.nodes.append(own)
        nearest = _distances(rows, points).argmin(1)
        for j in range(len(points)):
            below = rows[nearest == j]
            if level + 1 < levels and len(below) > 2 * ways and (below != below[0]).any():
                own.children.append(len(tree.nodes))
                node(below, level + 1)
            else:
                own.children.append(~tree.leaves)
                tree.leaves += 1

    if len(sample):
        node(sample, 0)
    else:
        tree.leaves = 1
    return tree


def route(tree: Tree, z: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    out = np.zeros(len(z), np.int32)
    inside = (np.abs(z) < LARGE).all(1)
    out[~inside] = OUTSIDE
    todo = [(0, np.flatnonzero(inside))] if tree.nodes else []
    while todo:
        k, rows = todo.pop()
        if not len(rows):
            continue
        node = tree.nodes[k]
        nearest = _distances(z[rows], node.points).argmin(1)
        for j, child in enumerate(node.children):
            some = rows[nearest == j]
            if child < 0:
                out[some] = ~child
            else:
                todo.append((child, some))
    return out


def _paths(tree: Tree) -> dict[int, list[tuple[int, int]]]:
    """For every leaf the (node, child) pairs that lead to it."""
    out, todo = {}, [(0, [])] if tree.nodes else []
    while todo:
        k, path = todo.pop()
        for j, child in enumerate(tree.nodes[k].children):
            if child < 0:
                out[~child] = [*path, (k, j)]
            else:
                todo.append((child, [*path, (k, j)]))
    return out


def survivors(tree: Tree, z: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[int, np.ndarray]:
    """For every leaf the rows (anchors) that have to search it for inner products in [lo, hi]; others are eliminated."""
    inside = (np.abs(z) < LARGE).all(1)
    out: dict[int, list] = {}
    every = np.flatnonzero(~inside)
    for leaf in range(tree.leaves):
        if len(every):
            out.setdefault(leaf, []).append(every)
    out[OUTSIDE] = [np.arange(len(z))]
    todo = [(0, np.flatnonzero(inside))]
    if not tree.nodes:
        out.setdefault(0, []).append(todo.pop()[1])
    while todo:
        k, rows = todo.pop()
        if not len(rows):
            continue
        node = tree.nodes[k]
        a = z[rows].astype(np.float64)
        norm = (a * a).sum(1)[:, None]
        to_point = np.sqrt(np.maximum(_distances(a, node.points), 0))  # [anchor, point]
        # The annulus of distances around the anchor in which a child's rows of the window lie: [anchor, child].
        outer = norm + node.norm_most[None] - 2.0 * lo[rows].astype(np.float64)[:, None]
        inner = norm + node.norm_least[None] - 2.0 * hi[rows].astype(np.float64)[:, None]
        open_ = outer >= -1e-6 * np.abs(norm)
        outer, inner = np.sqrt(np.maximum(outer, 0)) * (1 + 1e-9) + 1e-6, np.sqrt(np.maximum(inner, 0)) * (1 - 1e-9) - 1e-6
        for i in range(len(node.points)):
            d = to_point[:, i][:, None]
            nearest, farthest = np.maximum(inner - d, d - outer), outer + d
            open_ &= (node.most[i][None] >= nearest) & (node.least[i][None] <= farthest)
        for j, child in enumerate(node.children):
            some = rows[open_[:, j]]
            if child < 0:
                out.setdefault(~child, []).append(some)
            else:
                todo.append((child, some))
    return {leaf: np.concatenate(x) for leaf, x in out.items() if sum(map(len, x))}


# --- the index in Spark ---------------------------------------------------------------------------------------------

BLOCKS = "dim int, leaf int, part long, n int, ids binary, kinds binary, labels binary, ints binary"


def _labels(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy()


def _tree(trees: dict, dim: int) -> Tree:
    return trees.get(dim) or Tree()


def sample_trees(rows: DataFrame, scale: int, sample: int, ways: int = WAYS, levels: int = LEVELS) -> dict[int, Tree]:
    """A tree for each vector length in a sample of at most `sample` rows, those with the lowest hashes."""
    few = rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("__h")).orderBy("__h").limit(sample)
    held: dict[int, list] = {}
    column = few.select("embedding").toArrow()["embedding"]  # bounded by `sample`
    for chunk in column.chunks:
        for d, _, z in V.matrices(chunk, scale):
            held.setdefault(d, []).append(z[(np.abs(z) < LARGE).all(1)])
    # A length with few rows needs no tree.
    return {d: grow(z, ways, levels) for d, z in ((d, np.concatenate(x)) for d, x in held.items()) if len(z) > ways}


def index(rows: DataFrame, trees: dict[int, Tree], scale: int) -> DataFrame:
    """All valid rows (vec_id, label, embedding) as blocks by leaf, in order of vec_id within a block."""

    def run(batches):
        for batch in batches:
            ids, kinds = V.names(batch.column("vec_id"))
            labels = _labels(batch.column("label"))
            base = zlib.crc32(ids.tobytes()) << 24
            for d, at, z in V.matrices(batch.column("embedding"), scale):
                leaf = route(_tree(trees, d), z)
                out = []
                for x in np.unique(leaf):
                    some = np.flatnonzero(leaf == x)
                    for lo in range(0, len(some), V.BLOCK):
                        own = some[lo : lo + V.BLOCK]
                        own = own[V.by_name(ids[at[own]], kinds[at[own]])]
                        who = at[own]
                        out.append((d, int(x), base + len(out), len(own), ids[who].tobytes(), kinds[who].tobytes(), labels[who].tobytes(), V.packed(z[own])))
                if out:
                    yield _record(out, BLOCKS)

    return rows.select("vec_id", "label", "embedding").mapInArrow(tidied(run), BLOCKS)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, _TYPES[t]) for x, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


RANGES = "dim int, node int, child int, point int, least double, most double, norm_least double, norm_most double"


def measure(blocks: DataFrame, trees: dict[int, Tree]) -> dict[int, Tree]:
    """Trees with the distance ranges and norm ranges of all indexed rows; one small row per node, child and point is collected."""
    paths = {d: _paths(t) for d, t in trees.items()}

    def run(batches):
        held: dict = {}
        for batch in batches:
            for d, leaf, n, ints in zip(*[batch.column(c).to_pylist() for c in ("dim", "leaf", "n", "ints")]):
                z = V.unpacked(ints, n, d).astype(np.float64)
                norm = (z * z).sum(1)
                for k, j in paths[d][leaf] if d in paths and leaf != OUTSIDE else ():
                    apart = np.sqrt(np.maximum(_distances(z, trees[d].nodes[k].points), 0))
                    new = np.stack((apart.min(0), -apart.max(0), np.full(apart.shape[1], norm.min()), np.full(apart.shape[1], -norm.max())))
                    held[d, k, j] = np.minimum(held[d, k, j], new) if (d, k, j) in held else new
        rows = [(d, k, j, i, x[0, i], -x[1, i], x[2, i], -x[3, i]) for (d, k, j), x in held.items() for i in range(x.shape[1])]
        if rows:
            yield _record(rows, RANGES)

    each = blocks.select("dim", "leaf", "n", "ints").mapInArrow(tidied(run), RANGES)
    found = each.groupBy("dim", "node", "child", "point").agg(F.min("least"), F.max("most"), F.min("norm_least"), F.max("norm_most")).collect()  # the tree's size
    for t in trees.values():
        for node in t.nodes:
            p, c = len(node.points), len(node.children)
            node.least, node.most = np.full((p, c), np.inf), np.full((p, c), -np.inf)
            node.norm_least, node.norm_most = np.full(c, np.inf), np.full(c, -np.inf)
    for d, k, j, i, least, most, a, b in found:
        node = trees[d].nodes[k]
        # A hair wider, as distances are square roots.
        node.least[i, j], node.most[i, j] = least * (1 - 1e-9) - 1e-6, most * (1 + 1e-9) + 1e-6
        node.norm_least[j], node.norm_most[j] = a, b
    for t in trees.values():  # what holds nothing is closed: no infinities in the arithmetic
        for node in t.nodes:
            empty = ~np.isfinite(node.norm_least)
            node.norm_least[empty], node.norm_most[empty] = 0.0, 0.0
    return trees


# --- asking ---------------------------------------------------------------------------------------------------------

ASKS = "dim int, leaf int, part long, n int, anchors binary, ids binary, labels binary, windows binary, ints binary"
FOUND = "anchor long, window int, score long, vec_id long"


def _asks(trees: dict[int, Tree], width: int, home_only: bool):
    """Packs of anchors by the leaf they have to search, with their windows (lo, hi) x `width`."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            dims, homes, anchors, ids, labels = (batch.column(c).to_numpy() for c in ("dim", "leaf", "anchor", "vec_id", "label"))
            windows = batch.column("windows").flatten().to_numpy().reshape(n, width, 2)
            raw = batch.column("ints").to_pylist()
            base = zlib.crc32(anchors.tobytes()) << 24
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                z = np.stack([V.unpacked(raw[i], 1, int(d))[0].astype(np.int64) for i in at]) if d else np.zeros((len(at), 0), np.int64)
                if home_only:
                    visit = {int(x): np.flatnonzero(homes[at] == x) for x in np.unique(homes[at])}
                else:
                    w = windows[at]
                    some = w[:, :, 0] <= w[:, :, 1]
                    lo, hi = np.where(some, w[:, :, 0], ANY[1]).min(1), np.where(some, w[:, :, 1], ANY[0]).max(1)
                    asking = np.flatnonzero(some.any(1))
                    visit = {x: asking[who] for x, who in survivors(_tree(trees, int(d)), z[asking], lo[asking], hi[asking]).items()}
                out = []
                for leaf, who in visit.items():
                    for a in range(0, len(who), V.BLOCK):
                        own = who[a : a + V.BLOCK]
                        out.append((int(d), leaf, base + len(out), len(own), *[np.ascontiguousarray(x[at[own]]).tobytes() for x in (anchors, ids, labels, windows)], V.packed(z[own])))
                if out:
                    yield _record(out, ASKS)

    return run


def _search(width: int, k: int, same: bool):
    """From a cell's rows, blocks first: the first k rows of every window of every anchor that comes by."""

    def run(batches):
        now, held, rows = None, [], None
        for batch in batches:
            for kind, dim, leaf, row, cell, n, ids, kinds, labels, anchors, windows, ints in zip(*[
                    batch.column(c).to_pylist() for c in ("kind", "dim", "leaf", "row", "cell", "n", "ids", "kinds", "labels", "anchors", "windows", "ints")]):
                if (dim, leaf, row, cell) != now:
                    now, held, rows = (dim, leaf, row, cell), [], None
                ids, labels, z = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), V.unpacked(ints, n, dim)
                if kind == 0:
                    held.append((ids, np.frombuffer(kinds, np.int8), labels, z))
                    continue
                if not held:
                    continue
                if rows is None:
                    rows = [np.concatenate(x) for x in zip(*held)]
                    order = V.by_name(rows[0], rows[1])
                    rows = [x[order] for x in rows]
                    if rows[3].dtype != np.int64:
                        rows[3] = rows[3].astype(np.float64)  # once for all that ask
                asks = np.frombuffer(windows, np.int64).reshape(n, width, 2)
                for a in range(0, n, V.STRIP):
                    at = slice(a, a + V.STRIP)
                    yield from _strip(np.frombuffer(anchors, np.int64)[at], ids[at], labels[at], asks[at], z[at], rows, k, same)

    return run


def _strip(anchors, ids, labels, asks, z, rows, k, same):
    row_ids, row_kinds, row_labels, row_z = rows
    scores = V.products(z, row_z)
    V.hide_own(scores, ids, row_ids, row_kinds)
    scores[(labels[:, None] == row_labels[None]) != same] = V.lowest(scores)
    for w in range(asks.shape[1]):
        lo, hi = asks[:, w, 0][:, None], asks[:, w, 1][:, None]
        if not (lo <= hi).any():
            continue
        row, _, col = V.first_of(np.where((scores >= lo) & (scores <= hi), scores, V.lowest(scores)), k)
        if len(row):
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors[row]), pa.array(np.full(len(row), w, np.int32)), pa.array(scores[row, col].astype(np.int64)),
                 pa.array(row_ids[col], mask=row_kinds[col] == V.NAMELESS)], names=["anchor", "window", "score", "vec_id"])


def ask(anchors: DataFrame, blocks: DataFrame, cells: DataFrame, trees: dict[int, Tree], width: int, k: int, same: bool, home_only: bool, down: int) -> DataFrame:
    """(anchor, window, score, vec_id, rank): the first k rows of the anchors' windows, among rows of the same label or of others.

    `cells` has the number of cells of each leaf, `down` is the number of parts that the anchors are dealt into.
    """
    asks = anchors.mapInArrow(tidied(_asks(trees, width, home_only)), ASKS)
    none = F.lit(None).cast("binary")
    deal = lambda parts, salt: F.pmod(F.xxhash64("part", F.lit(salt)), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))
    key = ["dim", "leaf", "row", "cell", "kind", "part"]
    left = blocks.join(cells, ["dim", "leaf"]).withColumn("cell", deal(F.col("across"), "cell"))
    left = left.select("dim", "leaf", every(F.lit(down)).alias("row"), "cell", F.lit(0).alias("kind"), "part", "n", "ids", "kinds", "labels", none.alias("anchors"), none.alias("windows"), "ints")
    right = asks.join(cells, ["dim", "leaf"]).withColumn("row", deal(F.lit(down), "row"))
    right = right.select("dim", "leaf", "row", every(F.col("across")).alias("cell"), F.lit(1).alias("kind"), "part", "n", "ids", none.alias("kinds"), "labels", "anchors", "windows", "ints")
    met = left.unionByName(right).repartition(*key[:4]).sortWithinPartitions(*key)
    found = met.mapInArrow(tidied(_search(width, k, same)), FOUND)
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _windows(windows: list[tuple[Column, Column]]) -> Column:
    """lo and hi of each window, end to end; a window with lo above hi is not asked for."""
    return F.array(*[x.cast("long") for w in windows for x in w]).alias("windows")


def mine(table: DataFrame, anchor: Column, label: Column | None = None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = (FROM, UPTO), sample: int = SAMPLE, ways: int = WAYS, levels: int = LEVELS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of `table` where `anchor` holds.

    `table` has vec_id, embedding and label (or `label`, an expression). Positives are the first rows of the anchor's label;
    negatives of a positive are the first rows of other labels with a score from `window[0]` to `window[1]` per cent of it.
    """
    prepare(table.sparkSession)
    rows = table.select("vec_id", "embedding", (F.col("label") if label is None else label).cast("long").alias("label"), anchor.alias("asks"))
    rows = rows.filter("label is not null and embedding is not null")
    trees = sample_trees(rows, scale, sample, ways, levels)
    blocks = materialise(index(rows, trees, scale), "blocks")
    trees = measure(blocks, trees)
    sizes = blocks.groupBy("dim", "leaf").agg(F.sum("n").alias("n"))
    cells = materialise(sizes.select("dim", "leaf", F.ceil(F.col("n") / V.CELL).alias("across")), "cells")

    # Anchors: different rows that ask, with their integers and home leaf, named by a number.
    asking = rows.filter(F.col("asks") & F.col("vec_id").isNotNull()).select("vec_id", "label", "embedding").dropDuplicates()

    def homes(batches):
        for batch in batches:
            ids, labels, out = batch.column("vec_id").cast(pa.int64()).to_numpy(), _labels(batch.column("label")), []
            for d, at, z in V.matrices(batch.column("embedding"), scale):
                leaf = route(_tree(trees, d), z)
                out += [(int(ids[i]), int(labels[i]), d, int(leaf[m]), V.packed(z[m : m + 1])) for m, i in enumerate(at)]
            if out:
                yield _record(out, "vec_id long, label long, dim int, leaf int, ints binary")

    found = asking.mapInArrow(tidied(homes), "vec_id long, label long, dim int, leaf int, ints binary")
    anchors = materialise(found.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    down = max(1, math.ceil(anchors.count() / V.CELL))

    def asked(who, width, k, same, home_only):
        return ask(who, blocks, cells, trees, width, k, same, home_only, down)

    # Positives: what the home leaf gives bounds them from below.
    low, top = F.lit(ANY[0]), F.lit(ANY[1])
    near = asked(anchors.withColumn("windows", _windows([(low, top)])), 1, positives, True, True)
    bound = near.filter(F.col("rank") == positives).select(F.col("anchor").alias("_a"), F.col("score").alias("_least"))
    bounded = anchors.join(bound, F.col("anchor") == F.col("_a"), "left")
    bounded = materialise(bounded.select(*anchors.columns, _windows([(F.coalesce("_least", low), top)])), "bounded")
    first = materialise(asked(bounded, 1, positives, True, False).select("anchor", "rank", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")

    # Negatives: a window for each positive; what the home leaf gives raises its lower end.
    def with_windows(lowest):
        score = [F.max(F.when(F.col("rank") == r, F.col("positive_score"))) for r in range(1, positives + 1)]
        least = [F.max(F.when(F.col("rank") == r, lowest)) for r in range(1, positives + 1)]
        return [(F.coalesce(lo, F.lit(ANY[1])), F.coalesce(F.floor(s * window[1] / 100), F.lit(ANY[0]))) for lo, s in zip(least, score)]

    lowest = F.ceil(F.col("positive_score") * window[0] / 100)
    per_anchor = first.groupBy(F.col("anchor").alias("_a")).agg(_windows(with_windows(lowest)))
    windowed = materialise(anchors.join(per_anchor, F.col("anchor") == F.col("_a")).select(*anchors.columns, "windows"), "windowed")
    near = asked(windowed, positives, negatives, False, True)
    bound = near.filter(F.col("rank") == negatives).select(F.col("anchor").alias("_a"), (F.col("window") + 1).alias("_r"), F.col("score").alias("_least"))
    raised = first.join(bound, (F.col("anchor") == F.col("_a")) & (F.col("rank") == F.col("_r")), "left").withColumn("_least", F.coalesce("_least", lowest)).drop("_a", "_r")
    per_anchor = raised.groupBy(F.col("anchor").alias("_a")).agg(_windows(with_windows(F.col("_least"))))
    windowed = materialise(anchors.join(per_anchor, F.col("anchor") == F.col("_a")).select(*anchors.columns, "windows"), "raised")
    hard = asked(windowed, positives, negatives, False, False)
    hard = hard.select(F.col("anchor").alias("_a"), (F.col("window") + 1).alias("_r"), F.col("rank").alias("_rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = first.join(hard, (F.col("anchor") == F.col("_a")) & (F.col("rank") == F.col("_r")))
    out = out.join(anchors.select(F.col("anchor").alias("_a2"), F.col("vec_id").alias("anchor_id")), F.col("anchor") == F.col("_a2"))
    return out.select("anchor_id", "positive_id", F.col("_rank").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.z, c.z)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


@register("op12_hard_negatives", SQL)
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every embedding whose vec_id is divisible by 100; labels are off by one where it is divisible by 7."""
    table = load(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table, F.col("vec_id") % 100 == 0, label)
