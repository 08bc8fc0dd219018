"""Set join, recompression and mixing against brute force on the fixture."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tarnwatch.llm import mixing, recompress, set_join
from tests.llm.helpers import corpus, empty, frame, words


def brute_groups(rows):
    sets = []
    for r in rows:
        w = [x.lower() for x in words(r[1])]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


def test_groups_match_brute_force(spark):
    rows = corpus()
    out = set_join.join_groups(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_groups(rows)
    kept = Counter(r["doc_id"] for r in set_join.keep_one(frame(spark, rows)).collect())
    groups = set(brute_groups(rows))
    assert kept == Counter([g[2] for g in {(None, 1, g[2]) for g in groups if g[1]}] + [r[0] for r in rows if not words(r[1])])


def test_chain_and_borderline_pairs(spark):
    # 10 shingles shared of 12: 83 per cent links; 8 of 10 against 8 of 11 sits on either side of the threshold.
    base = [f"w{i}" for i in range(14)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x"])), (3, " ".join([*base, "x", "y"])), (4, " ".join([*base, "x", "y", "z", "q"])), (5, " ".join(base[:-3] + ["n1", "n2", "n3"]))]
    rows = [(i, t, None, None, None, None, None) for i, t in rows]
    out = set_join.join_groups(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_groups(rows)


def test_empty_tables(spark):
    none = empty(spark)
    assert set_join.join_groups(none).count() == 0 and set_join.keep_one(none).count() == 0
    assert recompress.remove_repeats(none).count() == 0
    assert mixing.mix(none).count() == 0


def test_repeats_match_brute_force(spark):
    rows = corpus()
    last = 1 << 62
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, last), last if r[0] is None else r[0])
    want = Counter()
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < (last if r[0] is None else r[0]):
                gone[i : i + 13] = [True] * 13
        want[r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    out = recompress.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out) == want
    assert all(sum(s["words"] for s in r["removed"]) == r["n_removed"] for r in out)


def test_copies_meet_in_no_task():
    """Of 400 documents with one text, every part gets some, and a bucket gets two entries of a representative, one of a window."""
    text, bits = " ".join(f"w{i}" for i in range(200)), 4
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(400), pa.int64()), "text_key": pa.array([77] * 400, pa.int64()), "text": [text] * 400})
    ids = recompress._row_ids(batch)
    assert set(recompress._part(ids, bits)) == set(range(16))
    posted = pa.Table.from_batches(recompress._representative_blocks(bits, 13)([batch]))
    for name, most in (("posted", 2), ("sure", 400)):
        table = posted.filter([(b < 1 << bits) == (name == "posted") for b in posted.column("bucket").to_pylist()])
        for b in set(table.column("bucket").to_pylist()):
            keys, owners, who = recompress._unblocked(table.filter([x == b for x in table.column("bucket").to_pylist()]))
            assert max(Counter(keys.tolist()).values()) <= (most if name == "posted" else most // 4)
    keys, more, doc = np.zeros(400, np.uint64), np.zeros(400, np.uint32), np.arange(400)
    first, late = recompress._decided_later(keys, more, doc)
    assert first.tolist() == [0] and sorted(late.tolist()) == list(range(1, 400))


def test_repeats_across_and_inside_chunks(spark, monkeypatch):
    """Small chunks and batches decide as large ones do."""
    rows = corpus()
    monkeypatch.setattr(recompress, "PER_BUCKET", 4_000)
    for size in ("1", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            out = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in recompress.remove_repeats(frame(spark, rows)).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = want if size != "1" else out
        assert out == want and sum(out.values()) == len(rows)


def test_mix_meets_targets(spark):
    rows = corpus()
    docs = frame(spark, rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() >= {"size", "taken", "copies", "_k"}
    taken, target, total = defaultdict(int), {}, 0
    for r in out:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        total += r["size"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    assert abs(sum(target.values()) - total) < 1e-6
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in out)
    copies = Counter(r["doc_id"] for r in mixing.materialise_mix(docs).collect())
    assert sum(copies.values()) == sum(r["copies"] for r in out)


def test_capped_sources(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 500), ("c", 490)], "source string, source_size long")
    out = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert out["a"] == 30.0 and abs(out["b"] - 970 * 2 / 3) < 1e-9 and abs(out["c"] - 970 / 3) < 1e-9
