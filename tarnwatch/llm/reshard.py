"""Resharding as a minimum-cost flow: which bytes must move when shard sizes change.

Old shards hold known bytes, new shards get capacities that share the bytes as evenly as whole bytes allow. Keeping a
byte in its shard costs nothing, moving one costs 1 (or the given distance of the two shards). The cheapest transport of
old sizes into capacities is found on the graph of shards (old x new nodes, never documents) by successive shortest
paths. Every flow from an old to another shard is one block transfer; documents fill the transfers in order of size,
smallest first, so that what moves is cut within a small document. Documents that no transfer takes stay where they are,
and only files of shards that a transfer touches are rewritten.

Running sums of bytes and row numbers go over (shard, size class) first and order rows only inside a cell of a shard, so
no shard is sorted in one task. Rows of one cell are split by a hash into `SPREAD` cells, which bounds a cell
when most documents have the same size.

Law: `bytes` - the 16 shards' sums of size differ by little more than one small document.

Defined results: a NULL text has size 1 and crc32 of nothing (0); NULL ids are placed like others; repeated rows are
documents of their own and may take different slots; an empty table gives no rows; extra columns are kept by `reshard`
and `reshard_files`, those with the name of one of its own as `<name>_given`. Texts of any length are one row of one file.
"""

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwatch.sources import snapshots

from .common import load, materialise, prefix_sums, shared_folder
from .registry import register

OLD_SHARDS, NEW_SHARDS = 12, 16
SPREAD = 64


def cheapest_transport(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flows (old, new) -> amount of least total cost; successive shortest paths with node potentials.

    `cost(i, j)` is not negative. Supplies and capacities have the same sum.
    """
    if sum(supply) != sum(capacity):
        raise ValueError("supplies and capacities must agree")
    n, m = len(supply), len(capacity)
    # Source 0, old shards 1..n, new shards n+1..n+m, sink last; edges as [to, room, cost, index of the reverse edge].
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(a, b, room, price):
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    sink = n + m + 1
    for i, amount in enumerate(supply):
        edge(0, 1 + i, amount, 0)
    for j, amount in enumerate(capacity):
        edge(n + 1 + j, sink, amount, 0)
    for i in range(n):
        for j in range(m):
            edge(1 + i, n + 1 + j, supply[i], cost(i, j))
    level, left = [0] * len(graph), sum(supply)
    while left:
        dist, came = [float("inf")] * len(graph), [None] * len(graph)
        dist[0], queue = 0, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                step = d + price + level[a] - level[b]
                if room and step < dist[b]:
                    dist[b], came[b] = step, (a, k)
                    heapq.heappush(queue, (step, b))
        level = [x + (d if d < float("inf") else 0) for x, d in zip(level, dist)]
        amount, b = left, sink
        while b:
            a, k = came[b]
            amount, b = min(amount, graph[a][k][1]), a
        b = sink
        while b:
            a, k = came[b]
            graph[a][k][1] -= amount
            graph[b][graph[a][k][3]][1] += amount
            b = a
        left -= amount
    return {(i, e[0] - n - 1): supply[i] - e[1] for i in range(n) for e in graph[1 + i] if n < e[0] < sink and supply[i] > e[1]}


def transfers(old: dict[int, int], shards: int, distance=None) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new shard. Old shards beyond the new number are emptied."""
    total, names = sum(old.values()), sorted(old)
    capacity = [total // shards + (1 if j < total % shards else 0) for j in range(shards)]
    away = distance or (lambda i, j: 1)
    flow = cheapest_transport([old[i] for i in names], capacity, lambda i, j: 0 if names[i] == j else away(names[i], j))
    return {(names[i], j): amount for (i, j), amount in flow.items()}


def reshard(docs: DataFrame, old_shard, shards: int = NEW_SHARDS, distance=None, keep: list[str] | None = None) -> DataFrame:
    """All rows of `docs`, all columns or those in `keep`, with `size`, `old_shard`, `shard` and `slot` (gapless from 0 in each shard).

    A column of `docs` that has the name of one of these (or `text_crc32`) is returned as `<name>_given`.
    """
    spark = docs.sparkSession
    named = {c: f"{c}_given" for c in keep or docs.columns if c in ("size", "old_shard", "shard", "slot", "text_crc32")}
    if taken := sorted(set(named.values()) & set(docs.columns)):
        raise ValueError(f"columns cannot be renamed, as these names are taken: {taken}")
    own = [named.get(c, c) for c in keep or docs.columns]
    docs = docs.withColumn("__old", old_shard.cast("int")).withColumnsRenamed(named)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*own, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col("__old").alias("old_shard"))
    order = ["size", "text_crc32", *(["doc_id"] if "doc_id" in own else [])]
    # Cells in order of size: the class of the size's logarithm in eighths, then a hash that splits equal sizes.
    spread = F.pmod(F.xxhash64("text_crc32", "doc_id" if "doc_id" in own else F.lit(0)), F.lit(SPREAD))
    rows = rows.withColumn("__cell", (F.floor(F.log2("size") * 8) * SPREAD + spread).cast("int"))
    sizes = {r[0]: int(r[1]) for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}  # one number per old shard
    flows = transfers(sizes, shards, distance) if sizes else {}
    cuts = _cuts(spark, flows)  # each old shard's bytes, smallest documents first, in consecutive stretches
    placed = prefix_sums(rows, ["old_shard"], "__cell", order, {"__before": "size"})
    # A document goes where its middle byte lies.
    middle = F.col("__before") + F.col("size") / 2
    placed = placed.join(cuts, F.col("old_shard") == F.col("__old"), "left")
    placed = materialise(placed.select(*own, "size", "text_crc32", "old_shard", _at(middle).alias("shard"), "__cell", F.lit(1).cast("long").alias("__one")), "placed")
    return prefix_sums(placed, ["shard"], "__cell", order, {"slot": "__one"}).drop("__cell", "__one")


def _cuts(spark: SparkSession, flows: dict[tuple[int, int], int]) -> DataFrame:
    """Per old shard the points where its bytes, smallest documents first, go over to another new shard: at most shards^2."""
    found, at = [], {}
    for (i, j), amount in sorted(flows.items(), key=lambda f: (f[0][0], f[0][0] == f[0][1], f[0][1])):
        found.append((i, j, at.get(i, 0)))
        at[i] = at.get(i, 0) + amount
    rows = spark.createDataFrame(found, "__old int, __new int, __from long")
    return rows.groupBy("__old").agg(F.array_sort(F.collect_list(F.struct("__from", "__new"))).alias("__cuts"))


def _at(place):
    """The new shard of the stretch that holds this point of an old shard's bytes."""
    return F.element_at(F.filter("__cuts", lambda c: c["__from"] <= place), -1)["__new"]


def write_layout(docs: DataFrame, old_shard, folder: str) -> snapshots.Snapshot:
    """Writes the documents, all columns and their shard as `old_shard`, into one folder per shard."""
    return snapshots.append(docs.withColumn("old_shard", old_shard.cast("int")).withColumn("__shard", F.col("old_shard")), folder, "__shard")


def rewrite_layout(spark: SparkSession, folder: str, shards: int = NEW_SHARDS, distance=None) -> list[int]:
    """Moves the fewest bytes between the shards of a written layout so that `shards` shards are even. Returns those rewritten."""
    base = snapshots.snapshot(spark, folder)
    if not base.entries:
        return []
    files = snapshots.read(spark, folder, base)
    where = files.metadataColumn("_metadata")
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    ident = F.col("doc_id") if "doc_id" in files.columns else F.lit(0)
    crc = F.crc32(text.cast("binary"))
    # Cells in order of size: the class of the size's logarithm in eighths, then a hash that splits equal sizes.
    cell = (F.floor(F.log2(size) * 8) * SPREAD + F.pmod(F.xxhash64(crc, ident), F.lit(SPREAD))).cast("int")
    named = files.withColumns({"__cell": cell, "__file": where["file_path"], "__place": where["row_index"]})
    cells = materialise(files.select(F.col("__shard").alias("__old"), cell.alias("__cell"), size.alias("__size")).groupBy("__old", "__cell").agg(F.sum("__size").alias("__size")), "cells")
    sizes = {r[0]: int(r[1]) for r in cells.groupBy("__old").agg(F.sum("__size")).collect()}  # one number per old shard
    # A cell goes as a whole where both its ends lie in one stretch. There are at most 250 * SPREAD cells to a shard.
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("__old").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("__start", before).join(_cuts(spark, transfers(sizes, shards, distance)), "__old")
    first, last = _at(F.col("__start")), _at(F.col("__start") + F.col("__size"))
    cells = materialise(cells.withColumn("__whole", F.when(first == last, first)), "cells")
    cut = cells.filter("__whole IS NULL")
    rows = named.select(F.col("__shard").alias("__old"), "__cell", size.alias("__size"), crc.alias("__crc"), ident.alias("__id"), "__file", "__place")
    rows = rows.join(cut.select("__old", "__cell", "__start", "__cuts"), ["__old", "__cell"])
    inside = Window.partitionBy("__old", "__cell").orderBy("__size", "__crc", "__id", "__file", "__place").rowsBetween(Window.unboundedPreceding, -1)
    # A document goes where its middle byte lies.
    middle = F.col("__start") + F.coalesce(F.sum("__size").over(inside), F.lit(0)) + F.col("__size") / 2
    single = materialise(rows.select("__old", "__file", "__place", _at(middle).alias("__new")), "cut-cells")
    moves = cells.select("__old", F.col("__whole").alias("__new")).filter("__new IS NOT NULL").union(single.select("__old", "__new")).filter("__old <> __new").distinct().collect()  # at most shards^2
    touched = sorted({x for m in moves for x in m})
    if touched:
        whole = named.join(cells.filter("__whole IS NOT NULL").select(F.col("__old").alias("__shard"), "__cell", F.col("__whole").alias("__new")), ["__shard", "__cell"])
        apart = named.join(cut.select(F.col("__old").alias("__shard"), "__cell"), ["__shard", "__cell"], "left_semi").join(single.select("__file", "__place", "__new"), ["__file", "__place"])
        own = [c for c in files.columns if c not in ("__shard", snapshots.WRITE)]
        moved = whole.select(*own, F.col("__new").alias("__shard")).unionAll(apart.select(*own, F.col("__new").alias("__shard")))
        snapshots.replace(moved.filter(F.col("__shard").isin(touched)), folder, base, touched)
    return touched


def read_layout(spark: SparkSession, folder: str, keep: list[str] | None = None) -> DataFrame:
    """A layout's documents from its files, with `size`, `text_crc32`, `old_shard`, `shard` and `slot` (gapless from 0 in each shard)."""
    files = snapshots.read(spark, folder)
    own = keep or [c for c in files.columns if c not in ("__shard", "old_shard", snapshots.WRITE)]
    text = F.coalesce("text", F.lit(""))
    rows = files.select(*own, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "old_shard", F.col("__shard").alias("shard"), F.lit(1).cast("long").alias("__one"))
    ident = ["doc_id"] if "doc_id" in own else []
    spread = F.pmod(F.xxhash64("text_crc32", *(ident or [F.lit(0)])), F.lit(SPREAD))
    rows = rows.withColumn("__cell", (F.floor(F.log2("size") * 8) * SPREAD + spread).cast("int"))
    return prefix_sums(rows, ["shard"], "__cell", ["size", "text_crc32", *ident], {"slot": "__one"}).drop("__cell", "__one")


def reshard_files(docs: DataFrame, old_shard, shards: int = NEW_SHARDS, distance=None, keep: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """`reshard` through files: writes the old layout, rewrites the shards that transfers touch, returns the rows read back.

    `folder` (a new one under the shared folder) holds the layout afterwards, to be read with `read_layout`.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tarnwatch/{spark.sparkContext.applicationId}/shards-{uuid.uuid4().hex}"
    named = _given(docs)
    write_layout(docs.withColumnsRenamed(named), old_shard, folder)
    rewrite_layout(spark, folder, shards, distance)
    return read_layout(spark, folder, [named.get(c, c) for c in keep] if keep else None)


def _given(docs: DataFrame) -> dict[str, str]:
    """New names for the columns of `docs` that are named like one of ours."""
    named = {c: f"{c}_given" for c in docs.columns if c.lower() in ("size", "old_shard", "shard", "slot", "text_crc32", snapshots.WRITE)}
    if taken := sorted({n.lower() for n in named.values()} & {c.lower() for c in docs.columns}):
        raise ValueError(f"columns cannot be renamed, as these names are taken: {taken}")
    return named


def rewrite(spark: SparkSession, placed: DataFrame, folder: str, columns: list[str]) -> list[int]:
    """Write the files of the shards that a transfer touches under `folder/shard=N`; other shards' files are left alone.

    Returns the rewritten shards. A shard is touched if a row enters or leaves it. `placed` must not be read from `folder`.
    The folder of a touched shard that keeps no row is deleted, as overwriting partitions leaves it alone.
    """
    moved = placed.filter("shard <> old_shard")
    touched = sorted(r[0] for r in moved.select(F.explode(F.array("shard", "old_shard"))).distinct().collect())  # shard numbers
    rows = placed.filter(F.col("shard").isin(touched)).select(*columns, "shard")
    rows.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    filled = {r[0] for r in rows.select("shard").distinct().collect()}  # shard numbers
    for shard in touched:
        if shard not in filled:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={shard}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return touched


def hashed_layout(shards: int = OLD_SHARDS):
    """The layout before resharding in the query: equal texts lie in one shard, whatever its size becomes."""
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(shards))


@register("op7_flow_resharding")
def op7_flow_resharding(spark, sf_dir):
    """All documents from 12 shards by text into 16 of near equal bytes, moving the fewest bytes; rows read from the files."""
    placed = reshard_files(load(spark, sf_dir, "documents"), hashed_layout(), keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
