"""Substring deduplication by recompression: words of repeated passages go, except in the document with the smallest id.

Recompression rewrites the word sequence in rounds. First every run of one word becomes a symbol named by word and
length; then, round by round, symbols fall into two classes by their names, and every neighbouring pair of a first-class
and a second-class symbol becomes one symbol named by the two. Names are hashes of content, so they are the same in all
documents and tasks. Whether symbols merge depends on them and their neighbours only: each symbol carries the stretch of
words that decides it, and a symbol whose stretch lies inside a window of words occurs in every occurrence of the window.

Every window of `WINDOW` words is represented by the symbol of this kind that spans the most words (of the highest such
level, among the first `TRIED` of a level; at level 0 a word itself, so there always is one). Equal windows have equal representatives, hence:

1. Spark groups representatives over all documents; those of at least two documents reveal candidates. A representative stands for several neighbouring windows and is posted once for them.
2. Only windows of candidates are verified: 96-bit hashes of their word sequences are grouped over all documents, and a
   window repeats if a document with a smaller id has it.
3. Words covered by a repeating window go. Windows are judged on the input, not on what is left.

Posted entries travel packed in blocks by hash bucket, decisions go back to their documents in packed blocks, and texts
travel compressed, twice. Texts are dealt by document and text, so copies of a text meet in no task. What a task's texts
decide among themselves is not gathered: a representative that several of its documents have is posted for the smallest
and the largest id alone, a window for the smallest, and the other entries go home by their owners, so a bucket holds at
most two entries (one document's) of a representative or window per `CHUNK` of text, however many documents have it.
Rows that agree in doc_id and text do meet in one task.

Defined results: NULL and empty texts and texts shorter than the window lose nothing; a NULL doc_id counts as larger than
all others; rows of one doc_id do not remove from one another, so repeated rows get equal results; an empty table gives
no rows.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (U64, Words, _powers, bucket_bits, by_bucket, groups_of, joined, keyed_blocks, load, mix, prepare,
                     row_chunks, string_buffers, text_bytes)
from .registry import register

WINDOW = 13
LEVELS = 5
TRIED = 4
CHUNK = 6 << 20
PER_BUCKET = 64 << 20  # bytes of text whose entries make a bucket
LAST = np.iinfo(np.int64).max  # stands for a NULL doc_id
_SALT = np.random.default_rng(99).integers(1, 2**63, 4 * (LEVELS + 2), dtype=np.uint64) * U64(2) + U64(1)


def representatives(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(word index at which a whole window starts, name of its representative), in order of the index."""
    h, counts = words.hashes, words.counts
    docs, total = len(counts), len(h)
    rest = np.repeat(words.first[1:], counts) - np.arange(total)
    whole = np.flatnonzero(rest >= window)
    if not len(whole):
        return whole, np.zeros(0, np.uint64)
    # Unique separators around texts: no window holds one, so no symbol that depends on one is a representative.
    at = np.arange(total) + words.owners() + 1
    n = total + docs + 1
    sym = mix(np.arange(n, dtype=np.uint64) + _SALT[-1])
    sym[at] = h
    begin = at[whole]
    names = mix(h[whole] ^ _SALT[0])
    width = np.ones(len(names), np.int64)
    # Runs: a maximal run depends on the symbols on either side.
    cuts = groups_of(sym)
    size = np.diff(cuts)
    sym = mix(sym[cuts[:-1]] * _SALT[1] + size.astype(np.uint64) * _SALT[2])
    first, last = np.maximum(cuts[:-1] - 1, 0), np.minimum(cuts[1:], n - 1) + 1
    _take_wider(names, width, begin, sym, size, first, last, n, window)
    for level in range(1, LEVELS + 1):
        a, b, c = _SALT[3 * level : 3 * level + 3]
        second = (mix(sym ^ a) >> U64(63)).astype(bool)
        pair = np.zeros(len(sym), bool)
        pair[:-1] = ~second[:-1] & second[1:]
        tail = np.zeros(len(sym), bool)
        tail[1:] = pair[:-1]
        j = np.flatnonzero(~tail)
        paired, is_second = pair[j], second[j]
        after = np.minimum(j + 1, len(sym) - 1)
        before = np.maximum(j - 1, 0)
        merged = mix(sym[j] * b + np.where(paired, sym[after], U64(0)) * c + U64(level))
        size = size[j] + np.where(paired, size[after], 0)
        # A pair decides itself; a first-class symbol stays alone because of the next one, a second-class one of the one before.
        first, last = np.where(~paired & is_second, first[before], first[j]), np.where(paired | ~is_second, last[after], last[j])
        sym = merged
        _take_wider(names, width, begin, sym, size, first, last, n, window)
    return whole, names


def _take_wider(names, width, begin, sym, size, first, last, n, window):
    """Gives each window a symbol of this level if one of those decided inside it spans at least as many words as the present."""
    ahead = np.concatenate(([0], np.cumsum(np.bincount(first, minlength=n))))  # symbols whose stretch starts before a place
    start = ahead[begin]
    for more in range(TRIED):
        j = np.minimum(start + more, len(sym) - 1)
        better = (start + more < len(sym)) & (last[j] <= begin + window) & (size[j] >= width + (more > 0))
        names[better] = sym[j[better]]
        width[better] = size[j[better]]


def window_hashes(words: Words, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 more bits of the word sequences that start at the given words."""
    power, inverse = _powers(len(words.hashes) + 1)
    out = []
    for salt in (_SALT[1], _SALT[2]):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words.hashes ^ salt) * power[: len(words.hashes)])))
        out.append(mix((sums[starts + window] - sums[starts]) * inverse[starts]))
    return out[0], (out[1] >> U64(32)).astype(np.uint32)


def _blocks(bits: int, keys: np.ndarray, owners: np.ndarray, ids: np.ndarray, extra: list[np.ndarray], open_: np.ndarray, sure: np.ndarray):
    """One record batch of blocks: the entries `open_` cut by their key's leading bits, with the ids of their owners, and
    the entries `sure`, which need no other document, cut by their owners' parts into buckets from 1 << bits on.

    The last 48 bits of a key travel; what is left of the first 16 is in the bucket's number.
    """
    rows = [[] for _ in range(5 + len(extra))]
    for beyond, pick in ((0, open_), (1 << bits, sure)):
        bucket = _part(ids, bits)[owners[pick]] if beyond else (keys[pick] >> U64(64 - bits)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        pick, cuts = pick[by], np.searchsorted(bucket[by], np.arange((1 << bits) + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            at = pick[cuts[b] : cuts[b + 1]]
            used, owner = np.unique(owners[at], return_inverse=True)
            columns = ((keys[at] & U64(0xFFFFFFFF)).astype(np.uint32), (keys[at] >> U64(32) & U64(0xFFFF)).astype(np.uint16),
                       owner.astype(np.uint32 if len(used) > 65535 else np.uint16), ids[used], *[x[at] for x in extra])
            for into, x in zip(rows, (beyond + int(b), *[x.tobytes() for x in columns])):
                into.append(x)
    names = ["bucket", "low", "high", "owner", "ids", "more", "place"][: len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=names)


def _once(ids: np.ndarray) -> np.ndarray:
    """Marks one row of each (doc_id, text_key): equal rows share what is sent to them."""
    first = np.zeros(len(ids), bool)
    first[np.unique(np.ascontiguousarray(ids).view("i8,i8").ravel(), return_index=True)[1]] = True
    return first


def _decided_shared(keys: np.ndarray, owners: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries to post and entries whose key occurs here under different ids; of the latter only the outermost ids are posted."""
    order = np.lexsort((owners, doc[owners], keys))
    k, o = keys[order], owners[order]
    order = order[np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))]
    k, d = keys[order], doc[owners[order]]
    cuts = groups_of(k)
    first, last = cuts[:-1], cuts[1:] - 1
    several = d[first] < d[last]
    inside = np.repeat(several, np.diff(cuts))
    posted = ~inside
    posted[first] = posted[last] = True
    return order[posted], order[inside]


def _decided_later(keys: np.ndarray, more: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the smallest id that has their key here, to post, and the others, which repeat it."""
    late = _later(keys, more, doc)
    least = np.ones(len(keys), bool)
    least[late] = False
    return np.flatnonzero(least), late


POSTED = "bucket int, low binary, high binary, owner binary, ids binary"


def _unblocked(table: pa.Table):
    """Entries of all blocks of a bucket: keys, owner index, and ids (doc_id, text_key) of the different owners."""
    keys = joined(table, "low", np.uint32).astype(np.uint64) | joined(table, "high", np.uint16).astype(np.uint64) << U64(32)
    owners, ids, at = [], [], 0
    for k, o, i in zip(table.column("low").to_pylist(), table.column("owner").to_pylist(), table.column("ids").to_pylist()):
        ids.append(np.frombuffer(i, np.int64).reshape(-1, 2))
        owners.append(np.frombuffer(o, np.uint16 if len(o) * 2 == len(k) else np.uint32).astype(np.int64) + at)
        at += len(ids[-1])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    ids, back = np.unique(ids.view("i8,i8").ravel(), return_inverse=True)
    return keys, back.ravel()[owners], ids.view(np.int64).reshape(-1, 2)


ROUTED = "part int, ids binary, counts binary, entries binary, body binary"


def _routed(bits: int, owners: np.ndarray, entries: np.ndarray, ids: np.ndarray):
    """Blocks of entries on the way back to their owners' parts."""
    order = np.argsort(owners, kind="stable")
    owners, entries = owners[order], entries[order]
    cuts = groups_of(owners)
    used = owners[cuts[:-1]]
    part = _part(ids[used], bits)
    by = np.argsort(part, kind="stable")
    edges = groups_of(part[by])
    for a, b in zip(edges[:-1], edges[1:]):
        which = by[a:b]
        pick = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in which])
        yield int(part[which[0]]), ids[used[which]].tobytes(), np.diff(cuts)[which].astype(np.uint32).tobytes(), entries[pick].tobytes(), None


def _route_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(5)], names=["part", "ids", "counts", "entries", "body"])


def _part(ids: np.ndarray, bits: int) -> np.ndarray:
    """The part of each (doc_id, text_key): copies of a text in several documents are spread."""
    return (mix(ids[:, 1].astype(np.uint64) ^ mix(ids[:, 0].astype(np.uint64) + _SALT[0])) >> U64(64 - bits)).astype(np.int64)


def _representative_blocks(bits: int, window: int):
    def run(batches):
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            ids = _row_ids(batch)
            for lo, hi in row_chunks(off, CHUNK):
                words = Words(data, off[lo : hi + 1], lower=False)
                start, names = representatives(words, window)
                if not len(start):
                    continue
                owner = np.repeat(np.arange(hi - lo), words.counts)[start]
                # Neighbouring windows of one representative are one entry.
                new = np.ones(len(names), bool)
                new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
                new &= _once(ids[lo:hi])[owner]
                names, owner = names[new], owner[new]
                if len(names):
                    yield _blocks(bits, names, owner, ids[lo:hi], [], *_decided_shared(names, owner, ids[lo:hi, 0]))

    return run


def _row_ids(batch) -> np.ndarray:
    doc = batch.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
    return np.stack((doc, batch.column("text_key").to_numpy()), axis=1)


def _shared_by_documents(bits: int):
    """Of a bucket's representatives, those of at least two documents, sent back to all of them."""

    def run(batches):
        for bucket, table in keyed_blocks(batches, "bucket"):
            keys, owners, ids = _unblocked(table)
            shared = _shared(keys, ids[owners, 0]) if bucket < 1 << bits else np.arange(len(keys))
            rows = list(_routed(bits, owners[shared], keys[shared].astype(np.uint32), ids))
            if rows:
                yield _route_batch(rows)

    return run


def _shared(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries whose key occurs under different ids."""
    order = np.argsort(keys)
    d, cuts = doc[order], groups_of(keys[order])
    several = np.minimum.reduceat(d, cuts[:-1]) < np.maximum.reduceat(d, cuts[:-1])
    return order[np.repeat(several, np.diff(cuts))]


def _later(keys: np.ndarray, more: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries whose key also occurs under a smaller id."""
    order = np.lexsort((more, keys))
    k, m, d = keys[order], more[order], doc[order]
    cuts = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]) | (m[1:] != m[:-1])) + 1, [len(k)]))
    least = np.repeat(np.minimum.reduceat(d, cuts[:-1]), np.diff(cuts))
    return order[d > least]


def _part_texts(table: pa.Table):
    """The texts of a part with their ids, and what was sent to them: address of each entry, addresses, entries."""
    is_text = table.column("body").is_valid()
    unpack = zstandard.ZstdDecompressor()
    texts, packs = [], table.filter(is_text)
    for body, sizes in zip(packs.column("body").to_pylist(), packs.column("counts").to_pylist()):
        body, off = unpack.decompress(body), np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))))
        texts += [body[a:b] for a, b in zip(off[:-1], off[1:])]
    sent = table.filter(pa.compute.invert(is_text))
    to, counts = joined(sent, "ids", np.int64).reshape(-1, 2), joined(sent, "counts", np.uint32)
    return joined(packs, "ids", np.int64).reshape(-1, 2), texts, np.repeat(np.arange(len(to)), counts), to, joined(sent, "entries", np.uint32)


def _match(ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each row of a part a number that equal (doc_id, text_key) share with the addressees; -1 where none is."""
    both, back = np.unique(np.concatenate((to, ids)).view("i8,i8").ravel(), return_inverse=True)
    back = back.ravel()
    known = np.zeros(len(both), bool)
    known[back[: len(to)]] = True
    own = back[len(to) :]
    return np.where(known[own], own, -1), back[: len(to)]


def _window_blocks(bits: int, window: int):
    """Exact hashes of the candidates' windows, in blocks: texts of a part against the representatives sent to them."""

    def run(batches):
        for _, table in keyed_blocks(batches, "part"):
            ids, texts, who, to, entries = _part_texts(table)
            if not len(entries) or not texts:
                continue
            own, number = _match(ids, to)
            wanted = np.sort(_tagged(entries.astype(np.uint64), number[who]))
            for rows in _portions([i for i in range(len(texts)) if own[i] >= 0], texts):
                words = _words_of([texts[i] for i in rows])
                start, names = representatives(words, window)
                owner = words.owners()[start]
                tags = _tagged(names, own[rows][owner])
                at = np.minimum(np.searchsorted(wanted, tags), len(wanted) - 1)
                hit = (wanted[at] == tags) & _once(ids[rows])[owner]
                start, owner = start[hit], owner[hit]
                if len(start):
                    h, more = window_hashes(words, start, window)
                    yield _blocks(bits, h, owner, ids[rows], [more, (start - words.first[owner]).astype(np.uint32)], *_decided_later(h, more, ids[rows][owner, 0]))

    return run


def _tagged(names: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One number for a representative's last 32 bits in a text; more than one may share it, which only adds candidates."""
    return mix((names & U64(0xFFFFFFFF)) ^ mix(number.astype(np.uint64) + _SALT[0]))


def _portions(rows: list, texts: list):
    held, size = [], 0
    for i in rows:
        held.append(i)
        size += len(texts[i])
        if size > CHUNK:
            yield np.array(held)
            held, size = [], 0
    if held:
        yield np.array(held)


def _words_of(texts: list[bytes]) -> Words:
    off = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    return Words(np.frombuffer(b"".join(texts), np.uint8), off, lower=False)


def _repeats(bits: int):
    """Of a bucket's windows, the places of those that a document with a smaller id has too, sent back."""

    def run(batches):
        for bucket, table in keyed_blocks(batches, "bucket"):
            keys, owners, ids = _unblocked(table)
            late = _later(keys, joined(table, "more", np.uint32), ids[owners, 0]) if bucket < 1 << bits else np.arange(len(keys))
            rows = list(_routed(bits, owners[late], joined(table, "place", np.uint32)[late], ids))
            if rows:
                yield _route_batch(rows)

    return run


KEPT = "doc_id long, n_words long, n_removed long, removed array<struct<first:int,words:int>>, kept_text string"


def _without(window: int):
    """Texts of a part without the words that the windows sent to them cover."""

    def run(batches):
        for _, table in keyed_blocks(batches, "part"):
            ids, texts, who, to, places = _part_texts(table)
            own, number = _match(ids, to)
            order = np.argsort(number[who], kind="stable")
            numbers, places = number[who][order], places[order].astype(np.int64)
            lo, hi = np.searchsorted(numbers, own), np.searchsorted(numbers, own, side="right")
            for a in range(0, len(texts), 500):
                out = [[], [], [], [], []]
                for i in range(a, min(a + 500, len(texts))):
                    words = texts[i].split()
                    spans = []
                    if own[i] >= 0 and hi[i] > lo[i]:
                        step = np.bincount(places[lo[i] : hi[i]], minlength=len(words) + 1) - np.bincount(places[lo[i] : hi[i]] + window, minlength=len(words) + 1)
                        gone = np.cumsum(step[: len(words)]) > 0
                        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                        spans = [{"first": int(s), "words": int(e - s)} for s, e in zip(edges[::2], edges[1::2])]
                        kept = [words[k] for k in np.flatnonzero(~gone)]
                    else:
                        kept = words
                    for into, x in zip(out, (None if ids[i, 0] == LAST else int(ids[i, 0]), len(words), len(words) - len(kept), spans, b" ".join(kept).decode("utf-8"))):
                        into.append(x)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    return run


def _texts(docs: DataFrame, bits: int) -> DataFrame:
    """Texts packed and compressed by the part their id and key belong to."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            ids = _row_ids(batch)
            part = _part(ids, bits)
            for lo, hi in row_chunks(off, CHUNK):
                by = lo + np.argsort(part[lo:hi], kind="stable")
                edges = groups_of(part[by])
                rows = []
                for a, b in zip(edges[:-1], edges[1:]):
                    which = by[a:b]
                    body = b"".join(data[off[i] : off[i + 1]].tobytes() for i in which)
                    rows.append((int(part[which[0]]), ids[which].tobytes(), (off[which + 1] - off[which]).astype(np.uint32).tobytes(), None, pack.compress(body)))
                yield _route_batch(rows)

    return docs.mapInArrow(run, ROUTED)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, removed spans, kept_text) per row of `docs`: kept words joined by one blank."""
    prepare(docs.sparkSession)
    bits = bucket_bits(text_bytes(docs), PER_BUCKET, 4)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    posted = docs.mapInArrow(_representative_blocks(bits, window), POSTED)
    candidates = by_bucket(posted, "bucket").mapInArrow(_shared_by_documents(bits), ROUTED)
    texts = _texts(docs, bits)
    windows = by_bucket(texts.unionByName(candidates), "part").mapInArrow(_window_blocks(bits, window), POSTED + ", more binary, place binary")
    repeats = by_bucket(windows, "bucket").mapInArrow(_repeats(bits), ROUTED)
    return by_bucket(texts.unionByName(repeats), "part").mapInArrow(_without(window), KEPT)


@register("op9_recompression")
def op9_recompression(spark, sf_dir):
    """Every document without the words of passages that a document with a smaller id has too."""
    out = remove_repeats(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
