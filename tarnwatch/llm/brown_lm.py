"""Brown class-based bigram model: exchange clustering of words, class transitions and word emissions.

Words are lower-cased (A-Z); every text ends with one end sign, which is a token, and starts after one.

    P(word | word before) = P(class | class before) * P(word | class)

Vocabulary. All words of the training texts are counted. Clustering moves *units*: every word seen at least `LEAST` times
is a unit of its own, and rarer words move together with the words of the same ending (`ENDINGS` groups), so every word,
seen or not, has a class. Units are told to all tasks, so a word must also have 1 in 2^20 of all tokens (`KNOWN_SHARE`):
that bounds what is sent to 2^20 words, and binds from 5 million tokens on.

Exchange. In every round half of the units are tried in every class, all others staying: the change of the class-bigram
log-likelihood is exact for a unit's counts of classes before and after. Spark adds up these counts, kept as sparse
(unit, side, class) entries in blocks of units; a round that does not improve the likelihood is taken back and ends the
search.

Probabilities. Transitions are smoothed towards the class's share. A word has (count + 1) of its class's
tokens + words + 1, which leaves one share to words that were never seen.

Counts of words with at least 1 in 2^20 tokens (so 2^20 words at most) are sent to all tasks. For the rest, texts post
their words to the buckets that hold the counts, and get back sums: nothing is left out and no table of all words is
ever in one place.

Defined results: NULL and empty texts consist of the end sign; a NULL doc_id is not held out; repeated rows count and are
scored each; without training texts N and V are 0 and every token has the probability of an unseen word.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, bucket_bits, by_bucket, crc32_of_id, joined, keyed_blocks, load, materialise, mix, prepare, row_chunks, string_buffers, text_bytes, tidied
from .registry import register

CLASSES = 64
ENDINGS = 1024
LEAST, KNOWN_SHARE = 5, 2**-20
ROUNDS = 5
BLOCK_UNITS = 4096
HELD = 2_000_000  # entries that a task holds before it hands them on
CHUNK = 6 << 20
END, END_CLASS = 0, 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def endings(words: Words) -> np.ndarray:
    """Group of each word by its last three bytes, lower-cased."""
    tail = np.zeros(len(words.ends), np.uint64)
    size = words.ends - words.starts
    for k in range(1, 4):
        byte = _LOWER[words.data[np.maximum(words.ends - k, 0)]].astype(np.uint64)
        tail = tail * U64(257) + np.where(size >= k, byte + U64(1), U64(0))
    return (mix(tail + U64(1)) % U64(ENDINGS)).astype(np.uint16)


@dataclass
class Vocabulary:
    """What all tasks know: frequent words in hash order with counts and units, and totals."""

    keys: np.ndarray
    counts: np.ndarray
    units: np.ndarray  # 0 where the word moves with its ending
    n_units: int  # end sign, own units, endings
    tokens: int
    types: int
    texts: int

    def clustered(self) -> tuple[float, float]:
        """Shares of the different words and of all words' tokens that are units of their own."""
        own = self.units > 0
        return float(own.sum() / max(1, self.types - (self.texts > 0))), float(self.counts[own].sum() / max(1, self.tokens - self.texts))

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the tables, whether the word is there) of each hash."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def units_of(self, at, known, ending) -> np.ndarray:
        own = np.where(known, self.units[at] if len(self.keys) else 0, 0)
        return np.where(own > 0, own, self.n_units - ENDINGS + ending.astype(np.int64))


def _word_blocks(bits: int):
    def run(batches):
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            for lo, hi in row_chunks(off, CHUNK):
                words = Words(data, off[lo : hi + 1], lower=True)
                keys, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
                groups = endings(words)[first]
                cuts = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << U64(64 - bits)), len(keys))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), *[pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()) for x in (keys, counts.astype(np.uint32), groups)]],
                    names=["bucket", "keys", "counts", "groups"])

    return run


def _added(batches):
    """Counts of a bucket's words added up."""
    for bucket, table in keyed_blocks(batches, "bucket"):
        keys, first, back = np.unique(joined(table, "keys", np.uint64), return_index=True, return_inverse=True)
        counts = np.bincount(back.ravel(), joined(table, "counts", np.uint32), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(bucket)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (keys, counts, joined(table, "groups", np.uint16)[first])],
             pa.array([int(counts.sum())]), pa.array([len(keys)])],
            names=["bucket", "keys", "counts", "groups", "tokens", "types"])


def count_words(train: DataFrame, bits: int) -> DataFrame:
    """(bucket, keys, counts, groups, tokens, types): every word's hash, count and ending, packed by bucket."""
    blocks = train.select("text").mapInArrow(_word_blocks(bits), "bucket int, keys binary, counts binary, groups binary")
    return materialise(by_bucket(blocks, "bucket", 1 << bits).mapInArrow(_added, "bucket int, keys binary, counts binary, groups binary, tokens long, types long"), "words")


def vocabulary(counted: DataFrame, texts: int) -> Vocabulary:
    tokens, types = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    total = tokens + texts

    def frequent(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                keep = counts >= total * KNOWN_SHARE
                yield pa.RecordBatch.from_arrays([pa.array([keys[keep].tobytes()], pa.binary()), pa.array([counts[keep].tobytes()], pa.binary())], names=["keys", "counts"])

    rows = counted.select("keys", "counts").mapInArrow(frequent, "keys binary, counts binary").collect()  # at most 2^20 words
    keys = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows] or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    own = np.flatnonzero(counts >= LEAST)
    own = own[np.argsort(-counts[own], kind="stable")]  # the most frequent word is unit 1
    units = np.zeros(len(keys), np.int32)
    units[own] = np.arange(1, len(own) + 1)
    return Vocabulary(keys, counts, units, 1 + len(own) + ENDINGS, total, types + (texts > 0), texts)


def unit_stream(train: DataFrame, vocab) -> DataFrame:
    """Training texts as packed unit numbers, every text with an end sign before and after its words."""

    def run(batches):
        v = vocab.value
        kind = np.uint16 if v.n_units < 65536 else np.uint32
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            for lo, hi in row_chunks(off, CHUNK):
                words = Words(data, off[lo : hi + 1], lower=True)
                at, known = v.look(words.hashes)
                out = np.zeros(len(at) + (hi - lo) + 1, kind)
                out[np.arange(len(at)) + words.owners() + 1] = v.units_of(at, known, endings(words))
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["units"])

    return materialise(train.select("text").mapInArrow(run, "units binary"), "units")


def _added_entries(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with their counts added up."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts


def _narrow(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(x.max(initial=0))).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64)


ENTRIES = "block int, n int, gaps binary, counts binary, bigrams binary"


def _entry_rows(keys: np.ndarray, counts: np.ndarray):
    """Entries cut by block of units: gaps between keys and counts, in as few bytes as they need."""
    step = BLOCK_UNITS * 2 * CLASSES
    cuts = [0, *(np.flatnonzero(np.diff(keys // step)) + 1), len(keys)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            block = int(keys[lo] // step)
            yield _entry_row(1 + block, hi - lo, _narrow(np.diff(keys[lo:hi].astype(np.int64), prepend=block * step)), _narrow(counts[lo:hi]), None)


def _entry_row(block, n, gaps, counts, bigrams):
    columns = [pa.array([block], pa.int32()), pa.array([n], pa.int32()), *[pa.array([x], pa.binary()) for x in (gaps, counts, bigrams)]]
    return pa.RecordBatch.from_arrays(columns, names=["block", "n", "gaps", "counts", "bigrams"])


def _context_counts(classes, n_units: int, turn: int):
    """Entries of the units whose turn it is, and the class bigrams of all tokens as block 0; blocks of units follow.

    An entry's key is (2 * unit + side) * CLASSES + class; side 0 counts the classes after a unit, side 1 those before.
    """

    def run(batches):
        of = classes.value
        kind = np.uint16 if n_units < 65536 else np.uint32
        bigrams = np.zeros(CLASSES * CLASSES, np.int64)
        keys, counts, held = [], [], 0
        for batch in batches:
            for raw in batch.column("units").to_pylist():
                u = np.frombuffer(raw, kind)
                c = of[u].astype(np.uint32)
                bigrams += np.bincount(c[:-1] * CLASSES + c[1:], minlength=len(bigrams))
                first = u.astype(np.uint32) * np.uint32(2 * CLASSES)
                moving = (u % 2 == turn % 2) & (u != END)
                found = np.concatenate(((first[:-1] + c[1:])[moving[:-1]], (first[1:] + c[:-1] + np.uint32(CLASSES))[moving[1:]]))
                some, times = np.unique(found, return_counts=True)
                keys.append(some)
                counts.append(times)
                held += len(some)
                if held > HELD:
                    some, times = _added_entries(keys, counts)
                    keys, counts, held = [some], [times], len(some)
                    if held > HELD // 2:
                        yield from _entry_rows(some, times)
                        keys, counts, held = [], [], 0
        if keys:
            yield from _entry_rows(*_added_entries(keys, counts))
        yield _entry_row(0, 0, None, None, bigrams.tobytes())

    return run


def _summed(batches):
    """One row per block with the entries of all tasks; a block's entries have bounded room whatever comes in."""
    size = BLOCK_UNITS * 2 * CLASSES

    def out(block, total):
        if block == 0:
            return _entry_row(0, 0, None, None, total.tobytes())
        keys = np.flatnonzero(total)
        return _entry_row(block, len(keys), _narrow(np.diff(keys, prepend=0)), _narrow(total[keys]), None)

    now = total = None
    for batch in batches:
        for block, n, gaps, counts, bigrams in zip(*[batch.column(c).to_pylist() for c in ("block", "n", "gaps", "counts", "bigrams")]):
            if block != now:
                if now is not None:
                    yield out(now, total)
                now, total = block, np.zeros(size if block else CLASSES * CLASSES, np.int64)
            if block == 0:
                total += np.frombuffer(bigrams, np.int64)
            else:
                total[np.cumsum(_wide(gaps, n))] += _wide(counts, n)  # keys of one row differ
    if now is not None:
        yield out(now, total)


def _phi(x):
    return x * np.log(np.maximum(x, 1))


def likelihood(bigrams: np.ndarray) -> float:
    """Class-bigram log-likelihood, up to what does not depend on the classes."""
    return float(_phi(bigrams).sum() - _phi(bigrams.sum(0)).sum() - _phi(bigrams.sum(1)).sum())


def best_classes(own: np.ndarray, keys: np.ndarray, counts: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """Class of largest gain of each unit that has entries; the others keep theirs.

    `own` are the units' classes, `keys` are sorted and numbered from the first of these units.
    """
    counts = counts.astype(float)
    unit, side, other = keys // (2 * CLASSES), keys // CLASSES % 2, keys % CLASSES
    dense = np.zeros((len(own), 2, CLASSES))
    dense.reshape(-1)[keys] = counts
    gain = np.zeros((len(own), CLASSES))
    for which, cells in ((0, bigrams.T), (1, bigrams)):
        at = side == which
        u, c, n = unit[at], other[at], counts[at]
        if not len(u):
            continue
        line, mine = np.arange(len(u)), own[u]
        # Cells that meet the entry's class, one per class the unit may go to, without the unit itself.
        without = cells[c]
        without[line, mine] -= n
        same = c == mine
        without[same] -= dense[u[same], 1 - which]
        np.maximum(without, 0, out=without)
        before = _phi(cells)[c]
        before[line, mine] = _phi(without[line, mine])
        before[same] = _phi(without[same])
        starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        gain[u[starts]] += np.add.reduceat(_phi(without + n[:, None]) - before, starts, axis=0)
    all_units = np.arange(len(own))
    for which, sums in ((0, bigrams.sum(1)), (1, bigrams.sum(0))):
        n = dense[:, which].sum(1)
        without = np.tile(sums, (len(own), 1))
        without[all_units, own] -= n
        gain -= _phi(without + n[:, None]) - _phi(without)
    gain[:, END_CLASS] = -np.inf  # the end sign keeps a class of its own
    return np.where(dense.any(axis=(1, 2)), gain.argmax(1), own)


def _moves(classes, bigrams: np.ndarray, step: int = 256):
    """New classes of a block's units, `step` units at a time."""

    def run(batches):
        of = classes.value
        for batch in batches:
            for block, n, gaps, counts in zip(*[batch.column(c).to_pylist() for c in ("block", "n", "gaps", "counts")]):
                start = (block - 1) * BLOCK_UNITS
                own = of[start : start + BLOCK_UNITS].astype(np.int64)
                keys, counts = np.cumsum(_wide(gaps, n)), _wide(counts, n)
                new = []
                for lo in range(0, len(own), step):
                    a, b = np.searchsorted(keys, (lo * 2 * CLASSES, (lo + step) * 2 * CLASSES))
                    new.append(best_classes(own[lo : lo + step], keys[a:b] - lo * 2 * CLASSES, counts[a:b], bigrams))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.concatenate(new).astype(np.uint8).tobytes()], pa.binary())], names=["block", "classes"])

    return run


def exchange(stream: DataFrame, n_units: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each unit, class bigrams, likelihoods of the rounds)."""
    sc = stream.sparkSession.sparkContext
    # The end sign has class 0; units start by rank, frequent words apart.
    classes = (1 + (np.arange(n_units) - 1) % (CLASSES - 1)).astype(np.uint8)
    classes[END] = END_CLASS
    best, history = None, []
    blocks = 1 + -(-n_units // BLOCK_UNITS)
    for turn in range(rounds + 1):
        shared = sc.broadcast(classes)
        parts = stream.mapInArrow(tidied(_context_counts(shared, n_units, turn)), ENTRIES)
        table = materialise(by_bucket(parts, "block", blocks).mapInArrow(tidied(_summed), ENTRIES), "contexts")
        found = table.filter("block = 0").select("bigrams").first()
        bigrams = (np.frombuffer(found[0], np.int64) if found else np.zeros(CLASSES * CLASSES)).astype(float).reshape(CLASSES, CLASSES)
        history.append(likelihood(bigrams))
        if best is not None and history[-1] <= best[2]:
            break
        best = (classes, bigrams, history[-1])
        if turn == rounds:
            break
        moved = table.filter("block > 0").mapInArrow(tidied(_moves(shared, bigrams)), "block int, classes binary").collect()  # a byte per unit, 2^20 at most
        classes = classes.copy()
        for block, new in moved:
            classes[(block - 1) * BLOCK_UNITS :][: len(new)] = np.frombuffer(new, np.uint8)
    return best[0].astype(np.int64), best[1], history


@dataclass
class BrownModel:
    vocab: Vocabulary
    classes: np.ndarray  # of each unit
    transition: np.ndarray  # log10 P(class | class before)
    room: np.ndarray  # log10 of tokens + words + 1 of each class
    counted: DataFrame
    bits: int


def learn(train: DataFrame) -> BrownModel:
    """Model of the texts in `train`."""
    spark = train.sparkSession
    prepare(spark)
    bits = bucket_bits(text_bytes(train), per_bucket=64 << 20, least=4)
    counted = count_words(train, bits)
    vocab = vocabulary(counted, train.count())
    told = spark.sparkContext.broadcast(vocab)
    stream = unit_stream(train, told)
    classes, bigrams, _ = exchange(stream, vocab.n_units)
    share = (bigrams.sum(0) + 1) / (bigrams.sum() + CLASSES)
    transition = (bigrams + share) / (bigrams.sum(1, keepdims=True) + 1)
    # Tokens and different words of each class: own units from the vocabulary, the others by ending.
    own = vocab.units > 0

    def by_ending(batches):
        for batch in batches:
            for keys, counts, groups in zip(*[batch.column(c).to_pylist() for c in ("keys", "counts", "groups")]):
                keys, counts, groups = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(groups, np.uint16)
                at, known = told.value.look(keys)
                rest = ~known
                rest[known] = told.value.units[at[known]] == 0
                t, n = np.bincount(groups[rest], counts[rest], ENDINGS), np.bincount(groups[rest], minlength=ENDINGS)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS)), pa.array(t.astype(np.int64)), pa.array(n)], names=["ending", "tokens", "types"])

    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(tokens, classes[vocab.units[own]], vocab.counts[own])
    np.add.at(types, classes[vocab.units[own]], 1)
    for ending, t, n in counted.select("keys", "counts", "groups").mapInArrow(by_ending, "ending long, tokens long, types long").groupBy("ending").agg(F.sum("tokens"), F.sum("types")).collect():  # ENDINGS rows
        c = classes[vocab.n_units - ENDINGS + ending]
        tokens[c] += t
        types[c] += n
    tokens[END_CLASS] += vocab.texts
    types[END_CLASS] += vocab.texts > 0
    return BrownModel(vocab, classes, np.log10(transition), np.log10(tokens + types + 1), counted, bits)


SIDES = "doc_id long, text_key long, n_tokens long, n_known long, base double, score double"


def _known_part(shared):
    """Per text what is known without the rare words' counts: transitions, class rooms, counts of frequent words."""

    def run(batches):
        vocab, classes, transition, room = shared.value
        of_end = math.log10(vocab.texts + 1)
        logs = np.log10(vocab.counts + 1.0)
        whole = math.log10(vocab.tokens + vocab.types + 1)
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            ids = batch.column("doc_id"), batch.column("text_key")
            for lo, hi in row_chunks(off, CHUNK):
                words = Words(data, off[lo : hi + 1], lower=True)
                at, known = vocab.look(words.hashes)
                n, owner = hi - lo, words.owners()
                units = np.zeros(len(at) + n + 1, np.int64)
                units[np.arange(len(at)) + owner + 1] = vocab.units_of(at, known, endings(words))
                c = classes[units]
                # A text's tokens are its words and the end sign that follows them.
                per_token = transition[c[:-1], c[1:]] - room[c[1:]]
                begin = words.first[:-1] + np.arange(n)
                score = np.add.reduceat(per_token, begin) if n else np.zeros(0)
                count_part = np.bincount(owner[known], logs[at[known]], n) if len(logs) else np.zeros(n)
                count_part += of_end
                tokens = words.counts + 1
                yield pa.RecordBatch.from_arrays(
                    [*[x.slice(lo, n) for x in ids], pa.array(tokens), pa.array(np.bincount(owner[known], minlength=n) + (vocab.texts > 0)),
                     pa.array(count_part - tokens * whole), pa.array(count_part + score)], names=["doc_id", "text_key", "n_tokens", "n_known", "base", "score"])

    return run


POSTED = "bucket int, keys binary, counts binary, owner binary, ids binary"


def _rare_words(shared, bits: int):
    """The other words of each text with their numbers, posted to the buckets that hold their counts."""

    def run(batches):
        vocab = shared.value[0]
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            ids = np.stack([batch.column(c).to_numpy() for c in ("doc_id", "text_key")], axis=1)
            for lo, hi in row_chunks(off, CHUNK):
                words = Words(data, off[lo : hi + 1], lower=True)
                _, known = vocab.look(words.hashes)
                keys, owner = words.hashes[~known], words.owners()[~known]
                if not len(keys):
                    continue
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                first = np.ones(len(keys), bool)
                first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(first)
                times = np.diff(np.append(at, len(keys))).astype(np.uint32)
                keys, owner = keys[at], owner[at]
                cuts = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << U64(64 - bits)), len(keys))
                rows = [[], [], [], [], []]
                for b in np.flatnonzero(np.diff(cuts)):
                    s = slice(cuts[b], cuts[b + 1])
                    used, at = np.unique(owner[s], return_inverse=True)
                    kind = np.uint16 if len(used) <= 65535 else np.uint32
                    small = times[s] if times[s].max() > 65535 else times[s].astype(np.uint16)
                    for into, x in zip(rows, (int(b), keys[s].tobytes(), small.tobytes(), at.astype(kind).tobytes(), ids[lo:hi][used].tobytes())):
                        into.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["bucket", "keys", "counts", "owner", "ids"])

    return run


def _priced(batches):
    """Sums of log10(count + 1) and of known tokens per text and bucket, from posted words and the bucket's counts."""
    for _, table in keyed_blocks(batches, "bucket"):
        is_count = table.column("ids").is_null()
        counts = table.filter(is_count)
        keys, n = joined(counts, "keys", np.uint64), joined(counts, "counts", np.int64)
        posted = table.filter(pa.compute.invert(is_count))
        for k, t, o, i in zip(*[posted.column(c).to_pylist() for c in ("keys", "counts", "owner", "ids")]):
            k, i = np.frombuffer(k, np.uint64), np.frombuffer(i, np.int64).reshape(-1, 2)
            t = np.frombuffer(t, np.uint16 if len(t) * 4 == k.nbytes else np.uint32)
            o = np.frombuffer(o, np.uint16 if len(o) * 4 == k.nbytes else np.uint32)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                c = np.where(keys[at] == k, n[at], 0)
            else:
                c = np.zeros(len(k), np.int64)
            known = np.bincount(o, t * (c > 0), len(i)).astype(np.int64)
            some = known > 0  # an unseen word adds log10(1)
            yield pa.RecordBatch.from_arrays([pa.array(i[some, 0]), pa.array(i[some, 1]), pa.array(np.bincount(o, t * np.log10(c + 1.0), len(i))[some]), pa.array(known[some])], names=["_d", "_k", "_log", "_known"])


def score(docs: DataFrame, model: BrownModel) -> DataFrame:
    """(doc_id, text_key, n_tokens, n_known, base, score) per row: log10 probabilities by unigram counts and by the model."""
    spark = docs.sparkSession
    prepare(spark)
    # The last bit of the key says that the id is NULL.
    text_key = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(-2)).bitwiseOR(F.isnull("doc_id").cast("long"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), text_key.alias("text_key"), "text")
    shared = spark.sparkContext.broadcast((model.vocab, model.classes, model.transition, model.room))
    sides = rows.mapInArrow(_known_part(shared), SIDES)
    posted = rows.mapInArrow(_rare_words(shared, model.bits), POSTED)
    counts = model.counted.select("bucket", "keys", "counts", F.lit(None).cast("binary").alias("owner"), F.lit(None).cast("binary").alias("ids"))
    priced = by_bucket(posted.unionByName(counts), "bucket", 1 << model.bits).mapInArrow(_priced, "_d long, _k long, _log double, _known long")
    priced = priced.groupBy("_d", "_k").agg(F.sum("_log").alias("_log"), F.sum("_known").alias("_known"))
    # Repeated rows are scored once and listed as often as they occur; their words were posted as often.
    first = {c: F.first(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")}
    sides = sides.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("_copies"), *first.values())
    out = sides.join(priced, (F.col("doc_id") == F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")
    more, seen = F.coalesce(F.col("_log") / F.col("_copies"), F.lit(0.0)), F.coalesce(F.expr("_known div _copies"), F.lit(0))
    out = out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(
        F.when(F.col("text_key") % 2 == 0, F.col("doc_id")).alias("doc_id"), "text_key", "n_tokens", (F.col("n_known") + seen).alias("n_known"), (F.col("base") + more).alias("base"), (F.col("score") + more).alias("score"))


def held_out():
    return F.coalesce(crc32_of_id(F.col("doc_id")) % 7 == 2, F.lit(False))


@register("op3_brown_classes")
def op3_brown_classes(spark, sf_dir):
    """All documents scored by a class model of the documents that are not held out; perplexity per token beside it."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs.filter(~held_out()))
    out = score(docs, model)
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(int(model.vocab.tokens)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
