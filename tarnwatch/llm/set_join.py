"""N-gram Jaccard self-join with set-relation skipping, down to groups of linked documents.

A document is the set of its distinct word shingles; two documents link when 100 |x n y| >= 80 |x u y|. The join is exact
and runs over prefix index lists: shingles are ordered by how many different sets hold them (rarest first, then by hash),
and two linked sets share a shingle within the first |x| - ceil(0.8 |x|) + 1 of each.

Relations between sets save most of the work:

* Equal sets are one set (documents are members of it).
* Shingles that only one set holds can be in no intersection. Sets of which more than a fifth is such are left out
  before any list is built, and for the others only the shared shingles travel.
* Block skipping: a list is cut into blocks of equal set size and position of the shingle. Sizes and positions bound
  the overlap of two blocks' sets, and pairs of blocks that cannot reach the threshold are skipped as a whole, as are
  blocks whose sets are already linked with one another.
* Answers from similar sets: every set is first held against a few leads of the lists it is in: the set with the fewest
  shingles of its own, which is the most similar to all others, and some drawn by hash. The nearest linked one is its
  leader. Two sets whose leaders differ get their answer from the leaders' overlap: the symmetric
  difference of x and y is at least that of the leaders less the distances of x and y to them. Only pairs that this
  cannot decide are compared themselves; sets that are connected already need no answer.

What is handed on is the components of the link relation, so links inside a group of thousands of near copies are never
listed. Shingles travel as 64-bit hashes packed in blocks (`common`); a set is named by a 128-bit hash of its content.

Defined results: NULL and empty texts and texts without words have no shingles and link with nothing; a text with fewer
words than a shingle is one shingle; the component of a document without links is its own doc_id; a NULL doc_id belongs
to its group, counts as no id (the group's id is that of the others, NULL if there is none); repeated rows are equal
documents; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (U64, Words, binary_array, bucket_bits, by_bucket, groups_of, joined, keyed_blocks, load, materialise,
                     mix, prepare, row_chunks, string_buffers, text_bytes, tidied)
from .components import components
from .registry import register

SHINGLE = 5
SIMILAR = 80  # per cent
CHUNK = 3 << 20  # bytes of text packed at once
PER_BUCKET = 16 << 20  # bytes of text whose shingles make a bucket
LEADS = 4  # sets of a list that the others are held against first
_PLACE = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of every shingle of consecutive texts; a text with fewer words has one of all its words."""
    h, counts = words.hashes, words.counts
    owner = words.owners()
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = np.zeros(len(h), np.uint64)
    span = len(h) - size + 1
    for k in range(size):
        if span > 0:
            full[:span] += h[k : k + span] * _PLACE[k]
    rest = np.repeat(words.first[1:], counts) - np.arange(len(h))  # words left in the text, this one included
    keep = rest >= size
    del rest
    full, who = full[keep], owner[keep]
    del owner, keep
    out = mix(full)
    del full
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        short = np.array([sum(int(x) * int(p) for x, p in zip(h[words.first[i] : words.first[i + 1]], _PLACE)) + int(counts[i]) for i in few], dtype=object)
        out = np.concatenate((out, mix(np.array([int(s) % 2**64 for s in short], np.uint64))))
        who = np.concatenate((who, few))
    return out, who


def distinct_shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, owner), in order of the hash."""
    h, who = shingles(words, size)
    order = np.lexsort((who, h)) if len(h) < 2 else _order(h, who)
    h, who = h[order], who[order]
    del order
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return h[new], who[new]


def _order(h: np.ndarray, who: np.ndarray) -> np.ndarray:
    order = np.argsort(h)
    g, w = h[order], who[order]
    # Ties of the hash are put in order of the owner where they are not.
    if ((g[1:] == g[:-1]) & (w[1:] < w[:-1])).any():
        order = np.lexsort((who, h))
    return order


def content_names(h: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    """128-bit names of sets: two sums of differently mixed members; (n, 2) numbers."""
    out = np.zeros((n, 2), np.uint64)
    np.add.at(out[:, 0], who, mix(h ^ U64(0x5851F42D4C957F2D)))
    np.add.at(out[:, 1], who, mix(h + U64(0x14057B7EF767814F)))
    return out


def _names_array(names: np.ndarray) -> pa.Array:
    return binary_array(names.reshape(-1).view(np.uint8), np.arange(len(names) + 1) * 16).cast(pa.binary())


def _text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def document_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, n_shingles, name) per row of `docs`; the name of an empty set is NULL."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", _text_key().alias("text_key"), "text")

    def run(batches):
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            for lo, hi in row_chunks(off, CHUNK):
                h, who = distinct_shingles(Words(data, off[lo : hi + 1], lower=True), size)
                n = np.bincount(who, minlength=hi - lo)
                names = _names_array(content_names(h, who, hi - lo))
                names = pa.array([x if c else None for x, c in zip(names.to_pylist(), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_key")], pa.array(n), names], names=["doc_id", "text_key", "n_shingles", "name"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(tidied(run), f"doc_id {kind}, text_key long, n_shingles long, name binary")


POSTED = "bucket int, low binary, high binary, owner binary, names binary, sizes binary"


def _packed(bits: int, size: int):
    """Packs the distinct shingles of a stretch of texts into a block per bucket; copies in the stretch are posted once."""

    def run(batches):
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            for lo, hi in row_chunks(off, CHUNK):
                h, who = distinct_shingles(Words(data, off[lo : hi + 1], lower=True), size)
                if not len(h):
                    continue
                names = content_names(h, who, hi - lo)
                n = np.bincount(who, minlength=hi - lo).astype(np.uint32)
                _, first = np.unique(names.view("V16").ravel(), return_index=True)
                once = np.zeros(hi - lo, bool)
                once[first] = True
                keep = once[who]
                h, who = h[keep], who[keep]
                cuts = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << U64(64 - bits)) if bits else np.zeros(1, np.int64)
                cuts = np.append(cuts, len(h))
                rows = [[], [], [], [], [], []]
                for b in np.flatnonzero(np.diff(cuts)):
                    part, owner = h[cuts[b] : cuts[b + 1]], who[cuts[b] : cuts[b + 1]]
                    used, at = np.unique(owner, return_inverse=True)
                    for into, x in zip(rows, (int(b), part.astype(np.uint32).tobytes(), (part >> U64(32)).astype(np.uint16).tobytes(),
                                              at.astype(np.uint32).tobytes() if len(used) > 65535 else at.astype(np.uint16).tobytes(),
                                              names[used].tobytes(), n[used].tobytes())):
                        into.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["bucket", "low", "high", "owner", "names", "sizes"])

    return run


def _unique_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different 16-byte names: (kept (n, 2), index of each in the kept, first place)."""
    order = np.lexsort((names[:, 1], names[:, 0]))
    s = names[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    back = np.empty(len(s), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], back, order[new]


SHARED = "part int, names binary, sizes binary, counts binary, shingles binary, spread binary"


def _shared_of_bucket(bits: int, parts: int):
    """From all blocks of a bucket: the shingles that at least two sets hold, packed by holder.

    The holders go to `parts` parts by their names; shingles keep the 48 bits they were posted with and their bucket.
    """

    def run(batches):
        for bucket, table in keyed_blocks(batches, "bucket"):
            keys, owners, names, sizes = [], [], [], []
            at = 0
            for block in table.to_batches():
                for low, high, owner, nm, sz in zip(*[block.column(c).to_pylist() for c in ("low", "high", "owner", "names", "sizes")]):
                    lo = np.frombuffer(low, np.uint32)
                    keys.append(lo.astype(np.uint64) | np.frombuffer(high, np.uint16).astype(np.uint64) << U64(32))
                    owners.append(np.frombuffer(owner, np.uint16 if len(owner) == 2 * len(lo) else np.uint32).astype(np.int64) + at)
                    names.append(np.frombuffer(nm, np.uint64).reshape(-1, 2))
                    sizes.append(np.frombuffer(sz, np.uint32))
                    at += len(sizes[-1])
            del table, block
            names, back, first = _unique_names(np.concatenate(names))
            sizes = np.concatenate(sizes)[first]
            keys, owners = np.concatenate(keys), back[np.concatenate(owners)]
            order = _order(keys, owners)
            keys, owners = keys[order], owners[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
            keys, owners = keys[new], owners[new]
            cuts = groups_of(keys)
            spread = np.diff(cuts)
            spread = np.repeat(spread, spread)
            held = spread > 1
            del order, new
            keys, owners, spread = keys[held], owners[held], np.minimum(spread[held], 2**32 - 1).astype(np.uint32)
            if not len(keys):
                continue
            # Sorted by holder; the names are sorted, so parts by their leading bits are stretches of holders.
            order = np.argsort(owners, kind="stable")
            keys, owners, spread = keys[order], owners[order], spread[order]
            keys = keys | U64(int(bucket) >> max(0, bits - 16)) << U64(48)
            cuts = groups_of(owners)
            used = owners[cuts[:-1]]
            part = (names[used, 0] >> U64(32)) % U64(parts)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                pick = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(p)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (names[used[at]], sizes[used[at]], np.diff(cuts)[at].astype(np.uint32), keys[pick], spread[pick])]],
                    names=["part", "names", "sizes", "counts", "shingles", "spread"])

    return run


def _candidate_sets(similar: int):
    """From all blocks of a part: sets with enough shared shingles to link at all, shingles by how many sets hold them."""

    def run(batches):
        for _, table in keyed_blocks(batches, "part"):
            names, back, first = _unique_names(joined(table, "names", np.uint64).reshape(-1, 2))
            sizes = joined(table, "sizes", np.uint32)[first].astype(np.int64)
            owner = np.repeat(back, joined(table, "counts", np.uint32))
            keys, spread = joined(table, "shingles", np.uint64), joined(table, "spread", np.uint32)
            shared = np.bincount(owner, minlength=len(names))
            enough = shared * 100 >= similar * sizes
            keep = enough[owner]
            owner, keys, spread = owner[keep], keys[keep], spread[keep]
            if not len(owner):
                continue
            order = np.lexsort((keys, spread, owner))
            keys = keys[order]
            cuts = groups_of(owner[order])
            who = np.flatnonzero(enough)
            for a in range(0, len(who), 2000):
                some = who[a : a + 2000]
                yield pa.RecordBatch.from_arrays(
                    [_names_array(names[some]), pa.array(sizes[some]), pa.array(shared[some]), binary_array(keys, cuts[a : a + len(some) + 1])],
                    names=["name", "n", "shared", "shingles"])

    return run


def candidate_sets(docs: DataFrame, size: int, similar: int) -> DataFrame:
    """(name, n, shared, shingles): the different sets of which at least `similar` per cent is held by another set too.

    `shingles` are the shared ones as packed 64-bit numbers, those that the fewest sets hold first.
    """
    prepare(docs.sparkSession)
    bits = bucket_bits(text_bytes(docs), PER_BUCKET, 5)
    parts = 1 << bits
    posted = docs.select("text").mapInArrow(tidied(_packed(bits, size)), POSTED)
    shared = by_bucket(posted, "bucket").mapInArrow(tidied(_shared_of_bucket(bits, parts)), SHARED)
    sets = by_bucket(shared, "part").mapInArrow(tidied(_candidate_sets(similar)), "name binary, n long, shared long, shingles binary")
    return materialise(sets, "sets")


def _least(similar: int, a, b):
    """Least overlap of linked sets with sizes a and b."""
    return F.ceil((a + b) * F.lit(similar) / F.lit(100 + similar))


def postings(sets: DataFrame, similar: int) -> DataFrame:
    """(shingle, name, n, pos, own): shared shingles within the prefix. The set's `own`, unshared, take the first positions."""

    def run(batches):
        for batch in batches:
            n, shared = (batch.column(c).to_numpy() for c in ("n", "shared"))
            prefix = n - -(-n * similar // 100) + 1
            take = np.clip(prefix - (n - shared), 0, shared)
            off = np.frombuffer(batch.column("shingles").buffers()[1], np.int32, len(n) + 1, batch.column("shingles").offset * 4) // 8
            keys = joined(pa.Table.from_batches([batch]), "shingles", np.int64)
            off = off - off[0]
            who = np.repeat(np.arange(len(n)), take)
            at = np.arange(len(who)) - np.repeat(np.cumsum(take) - take, take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[off[who] + at]), batch.column("name").take(pa.array(who)), pa.array(n[who]), pa.array((at + (n - shared)[who])), pa.array((n - shared)[who])], names=["shingle", "name", "n", "pos", "own"])

    return sets.mapInArrow(tidied(run), "shingle long, name binary, n long, pos long, own long")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds `na`, `nb` and `both` (exact size of the intersection) to pairs (a, b) of set names."""
    one = sets.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("_sa"))
    two = sets.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("_sb"))
    full = pairs.join(one, "a").join(two, "b")
    keep = [c for c in full.columns if c not in ("_sa", "_sb")]

    def run(batches):
        for batch in batches:
            both = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                    for x, y in zip(batch.column("_sa").to_pylist(), batch.column("_sb").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(both, pa.int64())], names=[*keep, "both"])

    types = dict(full.dtypes)
    return full.mapInArrow(tidied(run), ", ".join([*[f"{c} {types[c]}" for c in keep], "both long"]))


def _linked(similar: int):
    return F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * similar


def links(sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(a, b): enough links between different sets to connect all that are connected."""
    lists = materialise(postings(sets, similar), "lists")
    # A list of one set proposes nothing. Leads of a list: the set with the fewest shingles of its own, and some by hash.
    ranks = [F.struct("own", "n", "name")] + [F.struct(F.xxhash64("name", F.lit(k)).alias("own"), "n", "name") for k in range(1, LEADS)]
    first = lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("_long"), *[F.min(r).alias(f"_lead{k}") for k, r in enumerate(ranks)]).filter("_long > 1")
    leads = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_lead{k}.name").alias("b"), F.col(f"_lead{k}.n").alias("nb")) for k in range(LEADS)])
    toward = lists.join(first.select("shingle", leads.alias("_leads")), "shingle").select(F.col("name").alias("a"), F.col("n").alias("na"), F.explode("_leads").alias("_l"))
    toward = toward.select("a", "na", "_l.k", "_l.b", "_l.nb").filter("a <> b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similar)
    votes = toward.groupBy("a", "k", "b").agg(F.count(F.lit(1)).alias("_v"))
    chosen = votes.groupBy("a", "k").agg(F.max(F.struct("_v", "b")).alias("_c")).select("a", F.col("_c.b").alias("b")).distinct()
    star = materialise(overlaps(chosen, sets).filter(_linked(similar)), "star")
    found = star.select("a", "b")
    roots = materialise(components(found), "roots")

    # Leaders: the set's own star centre, or itself; distance is the size of the symmetric difference.
    centre = star.groupBy(F.col("a").alias("name")).agg(F.min(F.struct((F.col("na") + F.col("nb") - 2 * F.col("both")).alias("d"), "b")).alias("_s"))
    led = sets.select("name", "n").join(centre.select("name", F.col("_s.b").alias("_b"), F.col("_s.d").alias("_d")), "name", "left")
    led = led.join(roots.select(F.col("node").alias("name"), "root"), "name", "left")
    led = materialise(led.select("name", F.coalesce("root", "name").alias("root"), F.coalesce("_b", "name").alias("leader"), F.coalesce("_d", F.lit(0)).alias("far")), "led")
    lists = materialise(lists.join(first.select("shingle"), "shingle", "left_semi").join(led, "name"), "lists")

    # Blocks of a list: equal size and position. Pairs of blocks are skipped by bounds and where all is one component.
    blocks = lists.groupBy("shingle", "n", "pos").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    mixed = blocks.groupBy("shingle").agg(F.min("r0").alias("_r0"), F.max("r1").alias("_r1")).filter("_r0 <> _r1").select("shingle")
    blocks = materialise(blocks.join(mixed, "shingle", "left_semi"), "blocks")
    x, y = (blocks.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "pos", "r0", "r1")]) for s in "xy")
    near = x.join(y, "shingle").filter(
        ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("pos_x") <= F.col("pos_y"))))
        & (F.col("n_x") * 100 >= F.col("n_y") * similar)
        & (F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= _least(similar, F.col("n_x"), F.col("n_y")))
        & ~((F.col("r0_x") == F.col("r1_x")) & (F.col("r0_y") == F.col("r1_y")) & (F.col("r0_x") == F.col("r0_y"))))
    near = materialise(near.select("shingle", "n_x", "pos_x", "n_y", "pos_y"), "near_blocks")

    # Pairs of leaders whose followers meet in a pair of blocks, with the largest distances and sizes among these.
    side = lists.groupBy("shingle", "n", "pos", "leader", "root").agg(F.max("far").alias("far"))
    sx, sy = (side.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "pos", "leader", "root", "far")]) for s in "xy")
    groups = near.join(sx, ["shingle", "n_x", "pos_x"]).join(sy, ["shingle", "n_y", "pos_y"]).filter("root_x <> root_y")
    swap = F.col("leader_x") > F.col("leader_y")
    groups = groups.select(
        F.least("leader_x", "leader_y").alias("a"), F.greatest("leader_x", "leader_y").alias("b"),
        F.when(swap, F.col("far_y")).otherwise(F.col("far_x")).alias("fa"), F.when(swap, F.col("far_x")).otherwise(F.col("far_y")).alias("fb"),
        (F.col("n_x") + F.col("n_y")).alias("nn"))
    groups = materialise(groups.groupBy("a", "b").agg(F.max(F.col("fa") + F.col("fb")).alias("reach"), F.max("nn").alias("nn")), "leader_pairs")
    led_pairs = materialise(overlaps(groups, sets), "leader_overlaps")
    found = found.unionByName(led_pairs.filter(_linked(similar)).select("a", "b"))
    # Sets x, y link only if their symmetric difference is at most (|x|+|y|) (1 - s) / (1 + s).
    open_pairs = led_pairs.filter(~_linked(similar) & (
        (F.col("na") + F.col("nb") - 2 * F.col("both") - F.col("reach")) * (100 + similar) <= F.col("nn") * (100 - similar)))
    open_pairs = materialise(open_pairs.select("a", "b", (F.col("na") + F.col("nb") - 2 * F.col("both")).alias("apart")), "open")
    if open_pairs.isEmpty():
        return found

    # The rest is decided one by one, where the leaders' answer and own distances leave it open.
    roots = materialise(components(found), "roots")
    member = led.select("name", "leader", "far").join(roots.select(F.col("node").alias("name"), "root"), "name", "left")
    member = materialise(lists.select("shingle", "name", "n", "pos").join(member.withColumn("root", F.coalesce("root", "name")), "name"), "members")
    mx, my = (member.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "pos", "name", "leader", "root", "far")]) for s in "xy")
    pairs = near.join(mx, ["shingle", "n_x", "pos_x"]).join(my, ["shingle", "n_y", "pos_y"]).filter("root_x <> root_y")
    pairs = pairs.join(open_pairs, (F.least("leader_x", "leader_y") == F.col("a")) & (F.greatest("leader_x", "leader_y") == F.col("b")))
    pairs = pairs.filter((F.col("apart") - F.col("far_x") - F.col("far_y")) * (100 + similar) <= (F.col("n_x") + F.col("n_y")) * (100 - similar))
    pairs = pairs.select(F.least("name_x", "name_y").alias("a"), F.greatest("name_x", "name_y").alias("b")).distinct()
    return found.unionByName(overlaps(pairs, sets).filter(_linked(similar)).select("a", "b"))


def join_groups(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, root, group_rows) per row of `docs`.

    `root` names the component and `group_rows` counts its rows; both are NULL for a row that is alone.
    """
    held = materialise(document_sets(docs, size), "document_sets")
    sets = candidate_sets(docs, size, similar)
    roots = components(links(sets, similar))
    classes = held.filter("name is not null").groupBy("name").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    classes = classes.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    classes = materialise(classes, "classes")
    group = classes.groupBy("root").agg(F.min("_least").alias("component_id"), F.sum("_rows").alias("group_rows")).filter("group_rows > 1")
    # Only sets of groups of several rows are joined back.
    several = classes.select(F.col("name").alias("_name"), "root").join(group, "root")
    out = held.join(several, F.col("name") == F.col("_name"), "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root", "group_rows")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` but for groups of linked documents, of which one row stays: the smallest doc_id, then text."""
    rows = materialise(join_groups(docs).filter("root is not null").select("doc_id", "text_key", "root"), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = rows.groupBy("root").agg(F.min(rank).alias("_f"))
    rows = rows.join(first, "root").groupBy("doc_id", "text_key").agg(
        F.min((F.col("doc_id").eqNullSafe(F.col("_f.doc_id")) & (F.col("text_key") == F.col("_f.text_key"))).cast("int")).alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    rows = materialise(rows.withColumnsRenamed({"doc_id": "__kept_doc", "text_key": "__kept_key"}), "kept_one")
    same = (_text_key() == F.col("__kept_key")) & F.col("doc_id").eqNullSafe(F.col("__kept_doc"))
    out = docs.join(rows.filter("_stays = 0"), same, "left_anti")
    twins = rows.filter("_stays = 1 and _rows > 1")
    if twins.isEmpty():
        return out
    return out.join(twins, same, "left_anti").unionByName(out.join(twins, same, "left_semi").dropDuplicates(["doc_id", "text"]))


@register("op5_set_relation_join")
def op5_set_relation_join(spark, sf_dir):
    """Groups of documents linked by five-word shingles at a Jaccard similarity of at least 0.8."""
    return join_groups(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
