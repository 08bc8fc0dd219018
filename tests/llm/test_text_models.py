"""Language models, class model and ordinal classifier: values by hand where possible, held-out quality elsewhere."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from tarnwatch.llm import brown_lm, language_models, ordinal_quality
from tests.llm.helpers import corpus, empty, frame, words


def test_base_scores_are_exact_and_model_is_a_distribution(spark):
    docs = frame(spark, rows := corpus())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for r in rows:
        if not held(r[0]):
            counts.update([w.lower() for w in words(r[1])] + [None])
    total, types = sum(counts.values()), len(counts)
    model = brown_lm.learn(docs.filter(~brown_lm.held_out()))
    assert (model.vocab.tokens, model.vocab.types) == (total, types)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    out = brown_lm.score(docs, model).collect()
    want = Counter()
    for r in rows:
        w = [x.lower() for x in words(r[1])] + [None]
        want[r[0], len(w), sum(x in counts for x in w), round(sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    nothing = brown_lm.learn(empty(spark).select("doc_id", "text"))
    assert brown_lm.score(docs, nothing).count() == len(rows) and brown_lm.score(empty(spark), model).count() == 0


def test_exchange_finds_alternating_classes(spark):
    rng = random.Random(1)
    a, b = [f"a{i}x" for i in range(8)], [f"b{i}y" for i in range(8)]
    rows = [(i, " ".join(rng.choice(a if k % 2 else b) for k in range(60)), None, None, None, None, None) for i in range(80)]
    docs = frame(spark, rows)
    out = brown_lm.score(docs, brown_lm.learn(docs)).collect()
    assert sum(r["score"] for r in out) > 0.85 * sum(r["base"] for r in out)


def best_by_recount(units, classes, unit):
    """Class of largest likelihood for a unit, from class bigrams counted anew for every class."""
    found = []
    for c in range(1, brown_lm.CLASSES):
        of = classes.copy()
        of[unit] = c
        bigrams = np.zeros((brown_lm.CLASSES, brown_lm.CLASSES))
        np.add.at(bigrams, (of[units[:-1]], of[units[1:]]), 1)
        found.append(brown_lm.likelihood(bigrams))
    return found


def test_exchange_step_matches_recount():
    rng = np.random.default_rng(3)
    n = 40
    units = np.concatenate(([0], rng.zipf(1.3, 4000) % n, [0]))
    units = units[np.r_[True, units[1:] != units[:-1]]]  # a unit beside itself is moved as if its neighbour stayed
    classes = np.r_[0, rng.integers(1, 9, n - 1)]
    bigrams = np.zeros((brown_lm.CLASSES, brown_lm.CLASSES))
    np.add.at(bigrams, (classes[units[:-1]], classes[units[1:]]), 1)
    after = (2 * units[:-1]) * brown_lm.CLASSES + classes[units[1:]]
    before = (2 * units[1:] + 1) * brown_lm.CLASSES + classes[units[:-1]]
    keys, counts = np.unique(np.concatenate((after, before)), return_counts=True)
    got = brown_lm.best_classes(np.r_[classes, 5], keys, counts, bigrams)
    assert got[n] == 5  # no entries: it stays
    for unit in range(1, n):
        if not (units == unit).any():
            continue
        found = best_by_recount(units, classes, unit)
        assert math.isclose(found[got[unit] - 1], max(found), rel_tol=1e-12)


def test_entries_of_tasks_add_up():
    rng = np.random.default_rng(4)
    step = brown_lm.BLOCK_UNITS * 2 * brown_lm.CLASSES
    keys = rng.integers(0, 3 * step, 5000)
    counts = rng.integers(1, 70_000, 5000)
    rows = [r for part in range(4) for r in brown_lm._entry_rows(*brown_lm._added_entries([keys[part::4]], [counts[part::4]]))]
    rows.sort(key=lambda r: r.column("block")[0].as_py())
    want = np.bincount(keys, counts, 3 * step)
    for r in brown_lm._summed(iter(rows)):
        block, n, gaps, times, _ = (r.column(i)[0].as_py() for i in range(5))
        at = np.cumsum(brown_lm._wide(gaps, n)) + (block - 1) * step
        assert (want[at] == brown_lm._wide(times, n)).all()
        want[at] = 0
    assert not want.any()


def test_every_word_seen_five_times_is_a_unit(spark):
    rng = random.Random(6)
    often, seldom = [f"w{i}" for i in range(300)], [f"r{i}" for i in range(400)]
    texts = [" ".join([*rng.sample(often, 60), *seldom[4 * i % 400 :][:4]]) for i in range(200)]
    rows = [(i, x, None, None, None, None, None) for i, x in enumerate(texts)] + [(None, "w1 w2", *[None] * 5), (2**63 - 1, "w1 w2", *[None] * 5)]
    docs = frame(spark, rows)
    model = brown_lm.learn(docs)
    counts = Counter(w for r in rows for w in r[1].split())
    units = [w for w, n in counts.items() if n >= brown_lm.LEAST]
    assert int((model.vocab.units > 0).sum()) == len(units) and {f"w{i}" for i in range(300)} <= set(units)
    types, tokens = model.vocab.clustered()
    assert math.isclose(types, len(units) / len(counts)) and math.isclose(tokens, sum(counts[w] for w in units) / sum(counts.values()))
    out = brown_lm.score(docs, model).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert len({r["score"] for r in out if r["doc_id"] in (None, 2**63 - 1)}) == 1


def test_limits_of_rejection_hold_against_wrong_labels(spark):
    import pandas as pd

    rng = np.random.default_rng(7)
    tables = {"aa": None, "bb": None, "cc": None, "dd": None}

    def left_out(wrong):
        rows = [(x, int(n), [b if k == i else b + 3 for k in range(4)]) for i, x in enumerate(("aa", "bb")) for n, b in zip(rng.integers(50, 3000, 80), 2 + i + 0.05 * rng.standard_normal(80))]
        rows += [("aa", 800, [9.0, 2.0, 9.0, 9.0])] * wrong + [("cc", 500, [9.0, 9.0, 4.0, 9.0])] * 2
        return pd.DataFrame(rows, columns=["lang", "__n", "__bits"])

    clean, mixed = (language_models.LanguageModels(tables, 1.0, {}) for _ in range(2))
    language_models.calibrate(clean, left_out(0))
    language_models.calibrate(mixed, left_out(3))
    for model in (clean, mixed):
        mean, between, sign, limit = model.typical["aa"]
        reach = limit * math.sqrt(between + sign / 800)
        assert abs(mean - 2) < 0.05 and 0.3 < reach < 2  # ordinary texts pass, those with wrong labels do not
        assert model.typical["cc"][0] == 4.0 and model.typical["cc"][1:] == model.typical["dd"][1:]  # few texts: the spread of all
        assert all(math.isfinite(x) for x in model.typical["dd"])


def test_languages(spark):
    rng = random.Random(2)
    pools = {"aa": ["lorem", "dolor", "amet", "sit", "ipsum"], "bb": ["ölich", "keit", "über", "schau", "und"], "cc": ["queau", "été", "leçon", "ouique", "des"]}
    rows = [(i, " ".join(rng.choice(pools[x]) for _ in range(rng.randint(8, 60))).capitalize(), x, None, None, None, None) for i, x in enumerate(rng.choice(list(pools)) for _ in range(240))]
    docs = frame(spark, rows + [(900, None, "aa", None, None, None, None), (901, "12 !!", None, None, None, None, None), (902, "", "bb", None, None, None, None), (None, "lorem dolor", None, None, None, None, None),
                                (903, "жжж щщщ ъъъ ыыы эээ " * 30, None, None, None, None, None)])
    model = language_models.train(docs)
    out = {r["doc_id"]: r for r in language_models.predict(docs, model, ["doc_id", "lang", "_k"]).collect()}
    truth = {i: x for i, _, x, *_ in rows}
    right = [out[i]["lang_pred"] == x for i, x in truth.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(right) >= 0.97 * len(right)
    assert not any(out[i]["rejected"] for i in truth)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0.0 and out[i]["rejected"] for i in (900, 901, 902))
    assert out[None]["lang_pred"] == "aa" and out[903]["rejected"]
    none = empty(spark)
    assert language_models.predict(none, model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in language_models.predict(docs, language_models.train(none), ["doc_id"]).collect()} == {"und"}


def gram_table(texts):
    """The n-grams of the texts as `build` takes them."""
    rows = [[], [], [], []]
    for text in texts:
        hashes = language_models.gram_hashes(language_models.signs(text.encode())[0], language_models.ORDER)
        for n in range(1, language_models.ORDER + 1):
            g = hashes[n - 1][n - 1 :]
            low = hashes[n - 2] if n > 1 else None
            for into, x in zip(rows, (np.full(len(g), n), g, low[n - 2 : -1] if n > 1 else g * 0, low[n - 1 :] if n > 1 else g * 0)):
                into.append(x)
    n, g, ctx, tail = map(np.concatenate, rows)
    _, first, count = np.unique(g, return_index=True, return_counts=True)
    return {"n": n[first], "gram": g[first], "context": ctx[first], "tail": tail[first], "count": count}


def brute_bits(texts, text):
    """Bits of a text under interpolated Kneser-Ney, from strings and dictionaries."""
    order = language_models.ORDER
    spaced = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    seen = [Counter(s[i : i + n] for s in map(spaced, texts) for i in range(len(s) - n + 1)) for n in range(order + 2)]
    levels = []
    for n in range(1, order + 1):
        before = Counter(g[1:] for g in seen[n + 1])
        count = {g: seen[n][g] if n == order else before[g] for g in seen[n]}
        ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
        total, kinds = Counter(), Counter()
        for g, c in count.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += c > 0
        levels.append((count, ones / (ones + 2 * twos) if ones and twos else 0.75, total, kinds))
    bits, s = 0.0, spaced(text)
    for i in range(1, len(s)):
        p = 1 / (len(seen[1]) + 1)
        for n, (count, discount, total, kinds) in enumerate(levels, 1):
            g = s[i - n + 1 : i + 1] if i >= n - 1 else None
            if g is not None and total[g[:-1]]:
                p = max(count.get(g, 0) - discount, 0) / total[g[:-1]] + discount * kinds[g[:-1]] / total[g[:-1]] * p
        bits -= math.log2(p)
    return bits


def test_probabilities_match_brute_force():
    import pyarrow as pa

    from tarnwatch.llm.common import string_buffers

    rng = random.Random(4)
    learned = [" ".join(rng.choice(["stein", "stone", "ein", "one", "Öl"]) for _ in range(rng.randint(1, 30))) for _ in range(20)]
    asked = ["stone", "a", "Stein, one! 12 öl", "unseen words xyz", learned[0], "o" * 40]
    scorer = language_models.Scorer({"x": language_models.build(gram_table(learned))})
    count, bits = language_models.entropies(scorer, *string_buffers(pa.array(asked)))
    assert np.allclose(bits[:, 0] * count, [brute_bits(learned, t) for t in asked], rtol=1e-4)


def test_long_text_scores_as_in_one_piece(monkeypatch):
    import pyarrow as pa

    from tarnwatch.llm.common import string_buffers

    rng = random.Random(3)
    text = " ".join(rng.choice(["ab", "abc", "cab"]) for _ in range(900))
    scorer = language_models.Scorer({"x": language_models.build(gram_table([text]))})
    data, off = string_buffers(pa.array([text, None, "abc"]))
    whole = language_models.entropies(scorer, data, off)
    monkeypatch.setattr(language_models, "STRETCH", 64)
    pieces = language_models.entropies(language_models.Scorer(scorer.models), data, off)
    assert (whole[0] == pieces[0]).all() and np.allclose(whole[1], pieces[1], atol=1e-5)


def test_ordinal_grades(spark):
    rng = random.Random(5)
    neutral, poor, bad = [f"n{i}" for i in range(60)], ["zz1", "zz2", "zz3"], ["vile", "scum"]
    rows, grades = [], []
    for i in range(300):
        grade = i % 3
        text = [rng.choice(neutral) for _ in range(30)] + ([rng.choice(bad)] if grade == 0 else []) + (rng.sample(poor, 2) if grade == 1 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), None, None, None, None, None))
        if i < 200:
            grades.append((i, grade))
    docs = frame(spark, rows + [(None, None, None, None, None, None, None), (301, "", None, None, None, None, None)])
    ratings = spark.createDataFrame(grades + [(0, None), (None, 1)], "doc_id long, grade int")
    model = ordinal_quality.fit(docs, ratings, 2)
    assert model.offsets == sorted(model.offsets, reverse=True)
    out = {r["doc_id"]: r for r in ordinal_quality.score(docs, model).collect()}
    assert all(r["p_at_least_1"] >= r["p_at_least_2"] for r in out.values()) and len(out) == 302
    toxic = [out[i]["p_at_least_1"] for i in range(200, 300) if i % 3 == 0]
    others = [out[i]["p_at_least_1"] for i in range(200, 300) if i % 3]
    assert max(toxic) < min(others)
    one = ordinal_quality.fit(docs, ratings.filter("grade = 1"), 2)
    assert {(r["p_at_least_1"], r["p_at_least_2"]) for r in ordinal_quality.score(docs, one).collect()} == {(1.0, 0.0)}
    assert ordinal_quality.score(empty(spark), model).count() == 0
