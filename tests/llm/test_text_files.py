"""Fingerprints, decontamination, archives, shards and the pipeline."""

import hashlib
import itertools
import json
import math
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from tarnwatch.llm import arc_warc, decontaminate, mixing, multiset_print, reshard
from tarnwatch.llm.common import LOWER, UPPER
from tests.llm.helpers import corpus, empty, frame, words
from tests.llm.test_text_sets import brute_groups

LOWERED = dict(zip(UPPER, LOWER))


def test_next_document_and_fingerprints(spark):
    rows = corpus()
    texts = sorted(((r[0], r[1] or "") for r in rows if r[0] is not None), reverse=True)
    want = Counter((d, t, texts[(i + 1) % len(texts)][1]) for i, (d, t) in enumerate(texts))
    want[None, rows[[r[0] for r in rows].index(None)][1], texts[0][1]] += 1
    out = multiset_print.with_next(frame(spark, rows), per_bucket=5_000).collect()
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in out) == want
    by_text = defaultdict(set)
    for r in out:
        by_text[r["text"]].add(tuple(r["a"]))
        by_text[r["next_text"]].add(tuple(r["b"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert multiset_print.with_next(empty(spark)).count() == 0


def test_fingerprint_is_a_homomorphism(spark):
    df = spark.createDataFrame([("One.\nTwo.\nThree.\n", "Three.\nOne.\nTwo.\n", "Two.\n", "One.\nThree.\n")], "x string, y string, p string, q string")
    for c in "xypq":
        df = multiset_print.with_vector(df, c, f"v{c}")
    r = df.select("*", multiset_print.insert(F.col("vq"), F.col("vp")).alias("plus"), multiset_print.delete(F.col("vx"), F.col("vp")).alias("minus")).first()
    assert r["vx"] == r["vy"] and r["vx"] != r["vq"]
    assert r["plus"][1:] == r["vx"][1:] and r["minus"][1:] == r["vq"][1:]


def test_likeness_of_long_texts(spark):
    """A third of the parts replaced: likeness 2/3 at any length."""
    line = lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit("\n"))
    df = spark.createDataFrame([(300,), (3_000,), (50_000,)], "n int")
    at = F.sequence(F.lit(1), F.col("n"))
    df = df.withColumns({"x": F.concat_ws("", F.transform(at, line)), "y": F.concat_ws("", F.transform(at, lambda i: line(F.when(i % 3 == 0, -i).otherwise(i))))})
    for c in "xy":
        df = multiset_print.with_vector(df, c, f"v{c}")
    df = df.withColumns({f"cv{c}": multiset_print._centred(F.col(f"v{c}")) for c in "xy"})
    for r in df.select("n", "vx", multiset_print.likeness("vx", "vy").alias("near")).collect():
        assert r["vx"][0] == r["n"] and abs(r["near"] - 2 / 3) < 0.2, (r["n"], r["near"])


def test_leaks_with_substitutions(spark):
    item = [f"Item{i}" for i in range(30)]
    other = [f"other{i}" for i in range(40)]
    swapped = [w if i % 9 else "changed" for i, w in enumerate(item)]
    rows = [(1, " ".join(other + item + other)), (2, " ".join(other + swapped).upper()), (3, " ".join(other)), (4, " ".join(other + item[:9])), (5, "a b c d, e f"), (6, None), (None, " ".join(item)), (7, "")]
    rows = [(i, t, None, None, None, None, None) for i, t in rows] * 2
    bench = spark.createDataFrame([(10, ", ".join(item)), (11, "A b c d e f"), (12, None), (13, "x y"), (10, ", ".join(item))], "item_id long, text string")
    docs = frame(spark, rows)
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        decontaminate.BROADCAST_ROWS, old = limit, decontaminate.BROADCAST_ROWS
        try:
            found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
        finally:
            decontaminate.BROADCAST_ROWS = old
        assert found == {(1, 10), (2, 10), (None, 10), (5, 11)}
    left = Counter(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect())
    assert left == {3: 2, 4: 2, 6: 2, 7: 2}
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_beyond_the_broadcast_move_hits_only(spark, monkeypatch):
    """Of 60,000 stretches of documents only those that items may have, and of 300 texts only those with hits, go on to joins."""
    item = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(40)), None, None, None, None, None) for i in range(300)]
    rows += [(1000, " ".join(["a", "b", *item, "c"]), None, None, None, None, None), (None, " ".join(item), None, None, None, None, None)]
    bench = spark.createDataFrame([(i, " ".join(item)) for i in range(3)] + [(None, " ".join(item))], "item_id long, text string")
    docs, passed = frame(spark, rows), []
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "sift", lambda *a, own=decontaminate.sift: passed.append(own(*a)) or passed[-1])
    found = sorted((r["doc_id"] or 0, r["item_id"], r["start"], r["matched"]) for r in decontaminate.find_leaks(docs, bench).collect())
    assert found == [(0, i, 0, 13) for i in range(3)] + [(1000, i, 2, 13) for i in range(3)]
    stretches, texts = [p.count() for p in passed]
    assert 2 * sum(20 - m[-1] for m in decontaminate.MASKS) <= stretches < 1000 and 2 <= texts < 10


def test_sieve_holds_back_no_partner(spark):
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("h"))
    for known in (0, 1, 30_000):
        passed = decontaminate.sift(rows, rows.filter(F.col("id") < known), "h")
        assert passed.columns == ["id", "h"] and passed.filter(F.col("id") < known).count() == known
        assert passed.count() <= known + 400


def test_masks_hit_every_overlap_that_counts():
    for n in range(1, 14):
        lost = n - math.ceil(n * decontaminate.AGREE) if n >= decontaminate.SHORTEST else 0
        for gone in itertools.combinations(range(n), lost):
            hit = any(not {at + k for k in mask} & set(gone) for mask in decontaminate.masks_for(n) for at in range(n - mask[-1]))
            assert hit, (n, gone)


def test_leaks_with_every_replacement(spark):
    """Items of 1 to 14 words, each with as many replaced words as count, and one more."""
    bench, rows, want = [], [], set()
    for n in (1, 3, 4, 5, 6, 8, 12, 14):
        item = [f"n{n}w{k}" for k in range(n)]
        bench.append((n, " ".join(item)))
        width = min(n, 13)
        lost = width - math.ceil(width * decontaminate.AGREE) if n >= decontaminate.SHORTEST else 0
        for gone in itertools.combinations(range(width), lost + 1):
            for many in (gone, gone[:-1]):
                text = ["x" if k in many or k >= width else w for k, w in enumerate(item)]
                rows.append((len(rows), " ".join(["before", *text, "after"]), None, None, None, None, None))
                if len(many) == lost:
                    want.add((len(rows) - 1, n))
    bench = spark.createDataFrame(bench, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame(spark, rows), bench).collect()}
    assert found == want


PAGES = [(1, "http://a/ b", "x" * 1500, "u"), (2, "http://b", "x" * 1500, "u"), (9, None, "x" * 1500, "u"), (3, "http://c", "short", "u"), (4, "http://d", "short", "u"), (5, "", None, "u"),
         (6, "http://e", "é\r\n\r\nWARC/1.1\n" * 200, "u"), (None, "http://f", "y" * 2000, "u"), (7, "http://g", "y" * 2000, "u"), (7, "http://g", "y" * 2000, "u")]


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, extra string").repartition(2)
    arc_warc.write_arc(pages, str(tmp_path / "arc"))
    records = arc_warc.read_arc(spark, str(tmp_path / "arc")).collect()
    assert Counter(bytes(r["payload"]) for r in records) == Counter((h or "").encode() for _, _, h, _ in PAGES)
    assert {r["version"] for r in records} == {1, 2}
    arc_warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    out = arc_warc.page_records(spark, str(tmp_path / "warc")).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    want = Counter()
    for page, last in ((1, 9), (2, 9), (9, None), (3, None), (4, None), (5, None), (6, None), (None, 7), (7, None), (7, 7)):
        body = next((h or "").encode() for p, _, h, _ in PAGES if p == page)
        want[page, len(body), hashlib.sha1(body).hexdigest(), "response" if last is None else "revisit", last] += 1
    assert got == want and len({r["record_id"] for r in out}) == len(PAGES)


def test_archive_faults_are_named():
    block = b"1 0 x\n" + arc_warc.ARC_FIELDS[1].encode() + b"\n"
    head = b"filedesc://a.arc 0.0.0.0 20000101000000 text/plain %d\n" % len(block)
    good = head + block + b"\nhttp://x 1.1.1.1 20010203040506 text/html 3\nabc\n"
    assert [(r[0], r[3], r[7]) for r in arc_warc.parse_arc(good)] == [("a.arc", "http://x", b"abc")]
    for bad in (good.replace(b"html 3", b"html 300"), good.replace(b"text/html 3", b"3"), b"http://x 1 2 3 4\n"):
        with pytest.raises(ValueError):
            list(arc_warc.parse_arc(bad))


def test_transport_is_cheapest():
    for supply, shards in (([5, 0, 7, 3], 3), ([9, 1], 4), ([4, 4, 4], 3), ([0, 11], 2)):
        flows = reshard.transfers(dict(enumerate(supply)), shards)
        capacity = [sum(supply) // shards + (j < sum(supply) % shards) for j in range(shards)]
        assert [sum(a for (i, j), a in flows.items() if i == k) for k in range(len(supply))] == supply
        assert [sum(a for (i, j), a in flows.items() if j == k) for k in range(shards)] == capacity
        stay = sum(min(s, c) for s, c in itertools.zip_longest(supply, capacity, fillvalue=0))
        assert sum(a for (i, j), a in flows.items() if i != j) == sum(supply) - stay
    # A costly pair is avoided where another way is as short.
    flows = reshard.transfers({0: 6, 1: 0, 2: 0}, 3, lambda i, j: 1)
    assert flows[0, 0] == 2


def test_shards_are_even_and_gapless(spark, tmp_path):
    docs = frame(spark, corpus())
    out = reshard.reshard(docs, reshard.hashed_layout(5), shards=4).collect()
    assert len(out) == len(corpus()) and "_k" in out[0].asDict()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert reshard.reshard(empty(spark), reshard.hashed_layout()).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 97).cast("int")).alias("text"))
    total = reshard.reshard(many, F.pmod(F.xxhash64("doc_id"), F.lit(12))).groupBy("shard").agg(F.sum("size").alias("s")).agg(F.max("s"), F.min("s"), F.count("*")).first()
    assert total[2] == 16 and total[0] - total[1] <= 120


def test_rewrite_leaves_untouched_shards(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0, 0), (2, "b", 1, 0), (3, "c", 1, 1), (4, "d", 2, 2)], "doc_id long, text string, old_shard int, shard int")
    folder = str(tmp_path / "shards")
    rows.select("doc_id", "text", F.col("old_shard").alias("shard")).write.partitionBy("shard").parquet(folder)
    kept = sorted(p.name for p in (tmp_path / "shards" / "shard=2").iterdir())
    assert reshard.rewrite(spark, rows, folder, ["doc_id", "text"]) == [0, 1]
    assert sorted(p.name for p in (tmp_path / "shards" / "shard=2").iterdir()) == kept
    assert {(r["doc_id"], r["shard"]) for r in spark.read.parquet(folder).collect()} == {(1, 0), (2, 0), (3, 1), (4, 2)}


def test_rewrite_to_fewer_shards(spark, tmp_path):
    """16 shards become 12 on disk: every document is read back once, from its new shard."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    folder, old = str(tmp_path / "shards"), F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    docs.withColumn("shard", old).write.partitionBy("shard").parquet(folder)
    placed = reshard.reshard(docs, old, shards=12)
    assert set(range(12, 16)) <= set(reshard.rewrite(spark, placed, folder, ["doc_id", "text"]))
    back = Counter((r["doc_id"], r["text"], r["shard"]) for r in spark.read.parquet(folder).collect())
    assert back == Counter((r["doc_id"], r["text"], r["shard"]) for r in placed.collect()) and len(back) == 300
    assert {p.name for p in (tmp_path / "shards").glob("shard=*")} == {f"shard={k}" for k in range(12)}


def layout_files(folder):
    """Data files of the newest snapshot by shard, with name and modification time."""
    out = defaultdict(set)
    for write, value in json.loads(sorted((folder / "_log").glob("*.json"))[-1].read_text())["entries"]:
        for p in (folder / "data" / f"_write={write}" / f"__shard={value}").glob("*.parquet"):
            out[int(value)].add((str(p), p.stat().st_mtime_ns))
    return out


def test_resharding_rewrites_touched_files_only(spark, tmp_path, monkeypatch):
    # Shards of 600, 200 and 400 documents of 10 bytes: 200 go from the first to the second, the third is even.
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(9)).alias("text"), F.lit("kept").alias("Shard"), F.col("id").alias("slot"))
    uneven = F.when(F.col("doc_id") < 600, 0).when(F.col("doc_id") < 800, 1).otherwise(2)
    folder = tmp_path / "layout"
    reshard.write_layout(docs.withColumnsRenamed(reshard._given(docs)), uneven, str(folder))
    old = layout_files(folder)
    assert reshard.rewrite_layout(spark, str(folder), 3) == [0, 1]
    new = layout_files(folder)
    assert new[2] == old[2] and not new[0] & old[0] and not new[1] & old[1]
    rows = reshard.read_layout(spark, str(folder)).collect()
    assert Counter(r["shard"] for r in rows) == {0: 400, 1: 400, 2: 400} and len({r["doc_id"] for r in rows}) == 1200
    assert all(r["Shard_given"] == "kept" and r["slot_given"] == r["doc_id"] and r["size"] == 10 for r in rows)
    assert sum(r["shard"] != r["old_shard"] for r in rows) == 200 and {(r["old_shard"], r["shard"]) for r in rows} == {(0, 0), (0, 1), (1, 1), (2, 2)}
    assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(400)) for k in range(3))
    # Even shards stay as they are; a driver lost before its manifest leaves the layout whole.
    assert reshard.rewrite_layout(spark, str(folder), 3) == [] and layout_files(folder) == new

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(reshard.snapshots, "_renamed", killed)
        with pytest.raises(KeyboardInterrupt):
            reshard.rewrite_layout(spark, str(folder), 5)
    assert layout_files(folder) == new and reshard.read_layout(spark, str(folder)).count() == 1200


def test_resharding_through_files_matches_the_plan(spark, tmp_path):
    """Rows, sizes and moved bytes of the plan that `reshard` makes in memory, for more and for fewer shards."""
    more = [(9000 + i, "y" * (i % 37) * 5) for i in range(400)] + [(9999, "y" * 200_000), (9000, "")]
    rows = corpus() + [(d, t, "en", "s0", 1, "x", "y") for d, t in more]
    docs = frame(spark, rows)
    for old, shards in ((reshard.hashed_layout(5), 8), (F.pmod(F.xxhash64("text"), F.lit(7)), 3)):
        got = reshard.reshard_files(docs, old, shards).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
        slots, before, after = defaultdict(list), Counter(), Counter()
        for r in got:
            assert r["size"] == len((r["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
            slots[r["shard"]].append(r["slot"])
            before[r["old_shard"]] += r["size"]
            after[r["shard"]] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
        plan = reshard.reshard(docs, old, shards).collect()
        moved = lambda rs: sum(r["size"] for r in rs if r["shard"] != r["old_shard"])
        assert Counter(r["old_shard"] for r in plan) == Counter(r["old_shard"] for r in got)
        assert abs(moved(plan) - moved(got)) <= 2 * shards * max(r["size"] for r in got if r["size"] < 200_000)
        planned = Counter()
        for r in plan:
            planned[r["shard"]] += r["size"]
        assert all(abs(planned[k] - after[k]) <= 2 * max(r["size"] for r in got if r["size"] < 200_000) for k in range(shards))
    assert reshard.reshard_files(empty(spark), reshard.hashed_layout()).count() == 0
    assert [c for c in reshard.reshard_files(docs, reshard.hashed_layout(), keep=["doc_id"]).columns] == ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot"]


def check_languages(before, after):
    """Only whole rows go: those without letters, and next to no others."""
    gone = Counter(before) - Counter(after)
    assert not Counter(after) - Counter(before)
    plain = [r for r in before if not any(c.isalpha() for c in r["text"] or "")]
    assert all(gone[r] for r in plain) and sum(gone.values()) - len(plain) <= 0.02 * len(before)


def check_copies(before, after):
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before])
    assert Counter(r["doc_id"] for r in after) == Counter(d for d, n, least in groups.elements() if not n or d == least)
    assert not Counter(after) - Counter(before)


def check_leaks(before, after, items):
    """Documents that hold 13 words of an item, or a short item, go; each that goes has 10 equal words of some 13."""
    plain = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").translate(str.maketrans(LOWERED)))
    items = [w for w in map(plain, items) if len(w) >= decontaminate.SHORTEST]
    runs = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12))}
    lengths = {len(r) for r in runs}
    left = Counter(after)
    assert not left - Counter(before)
    for r in before:
        words = plain(r["text"])
        if any(tuple(words[i : i + n]) in runs for n in lengths for i in range(len(words) - n + 1)):
            assert r not in left
        elif r not in left:
            assert any(near(words, item) for item in items)


def near(words, item):
    width = min(13, len(item))
    for start in range(-len(item) + 1, len(words)):
        same = [0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(item)]
        if any(sum(same[k : k + width]) >= decontaminate.AGREE * width for k in range(len(item) - width + 1)):
            return True
    return False


def check_mix(before, after):
    """Repeated water-filling; the copies of a document differ by one at most within a source and add up to the target."""
    size = {r: len(words(r["text"])) for r in before}
    sources = sorted({r["source"] for r in before}, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    own = {s: sum(size[r] for r in before if r["source"] == s) for s in sources}
    budget, free, target = sum(own.values()), set(sources), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * own[s]}
        target |= {s: 3 * own[s] for s in full} if full else {s: level * weight[s] for s in free}
        budget -= sum(3 * own[s] for s in full)
        free = free - full if full else set()
    copies = Counter(after)
    assert not set(copies) - set(before)
    for s in sources:
        whole, rows = int(target[s] / own[s] + 1e-9), [r for r in before if r["source"] == s]
        assert all(copies[r] in (whole, whole + 1) for r in rows if size[r])
        assert abs(sum(copies[r] * size[r] for r in rows) - target[s]) <= max(size[r] for r in rows)


def check_shards(before, after, columns):
    assert Counter(tuple(r[c] for c in columns) for r in after) == Counter(map(tuple, before))
    sizes, slots = Counter(), defaultdict(list)
    for r in after:
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 1
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(len((r["text"] or "").encode()) for r in after)


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    checks = [check_languages, check_copies, lambda a, b: check_leaks(a, b, items), check_mix, lambda a, b: check_shards(a, b, columns)]
    for (name, stage), check in zip(corpus_pipeline.STAGES, checks, strict=True):
        stage(spark, docs, sf).write.parquet(path := str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(path)
        assert check is checks[-1] or docs.columns == columns
        check(before, after := docs.collect())
        before = after


CLASHING = ["size", "shard", "slot", "target", "taken", "copies", "source_size", "score", "lang_pred", "rejected", "bits_per_sign", "root", "name", "words", "__row odd"]


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like the stages' own come back with their values; repeated rows and NULLs are taken."""
    import corpus_pipeline

    docs = frame(spark, corpus()).drop("size")
    docs = docs.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r[c] == c + ("-" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for c in CLASHING)
    out = corpus_pipeline.sharded(spark, docs, "").collect()
    assert all(r["size_given"].startswith("size") and r["shard_given"].startswith("shard") and r["slot_given"].startswith("slot") for r in out)
    assert all(isinstance(r["shard"], int) for r in out) and len(out) == docs.count()


def test_stages_take_empty_tables(spark):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), "/root/testdata/sf0.001").count() == 0
