"""Language identification by interpolated Kneser-Ney character models.

A text is read as lower-case letters; everything between letters is one boundary sign. Every language has a character
model of order `ORDER`: the highest order discounts raw counts, lower orders discount continuation counts (the number of
different signs seen before), and each order is interpolated with the one below, down to the uniform distribution. A
model is stored as sorted arrays of n-gram hashes with their discounted probabilities and of context hashes with their
interpolation weights. The language with the lowest cross-entropy per sign is predicted.

Score: a softmax over the languages' cross-entropies at a temperature fitted on texts left out of training. Rejection:
a text without letters, or whose cross-entropy under the best language lies more than `LIMIT` spreads above that
language's median. The spread is a robust one (median distances of texts left out of training, between texts and per
sign), so a few mislabelled texts do not widen it; a language with under `FEW` such texts takes the spread of all, and
its median too if it has none. Where no text at all was left out, only texts without letters are rejected.

Counting and scoring run in Spark tasks. Training uses about `SAMPLE` whole texts per language at most, chosen by a hash
of doc_id (a documented bound); n-grams are counted in Spark. The models are broadcast: their size is bounded by the
sample. Scoring is by stretches of a text with carried context, so a very long text needs no more memory than others.

Defined results: a NULL text or one without letters gives `und`, score 0, and is rejected; without any training text all
documents give `und`; repeated rows give equal results; ties between languages go to the first in name order.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, crc32_of_id, load, materialise, mix, prepare, row_chunks, string_buffers, tidied
from .registry import register

ORDER = 5
SAMPLE = 400
STRETCH = 1 << 18  # bytes of text scored at once
LIMIT = 12.0
FEW = 5
KEPT = 1_000_000  # n-grams whose scores a task keeps
SIGN = 32  # code of everything that is no letter
_LETTERS: list = []
_STEP = U64(0x100000001B3)


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def signs(raw: bytes) -> tuple[np.ndarray, bool]:
    """Codes of the letters in lower case with single boundary signs between and around them; whether there is a letter."""
    codes = np.frombuffer(raw.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32), False
    codes = np.where(letter, codes, SIGN).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    return np.concatenate((np.full(1, SIGN, np.uint32), codes, np.full(0 if codes[-1] == SIGN else 1, SIGN, np.uint32))), True


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, n = 1..order; where fewer signs precede, of what there is."""
    h = mix(codes.astype(np.uint64) + U64(1))
    out = [h]
    for n in range(2, order + 1):
        longer = out[-1].copy()
        # The (n-1)-gram before and the sign itself.
        longer[n - 1 :] = mix(out[-1][n - 2 : -1] * _STEP + h[n - 1 :] * U64(2 * n + 1)) if len(codes) >= n else longer[n - 1 :]
        out.append(longer)
    return out


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, n, gram, context, tail, count) over all texts: n-grams of every order, added up in tasks, then in a shuffle.

    `context` is the hash of the first n-1 signs, `tail` of the last n-1 signs.
    """

    def run(batches):
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                rows = [[], [], [], []]
                for k in (i for i, x in enumerate(langs) if x == lang):
                    codes, any_letter = signs(data[off[k] : off[k + 1]].tobytes())
                    if not any_letter:
                        continue
                    grams = gram_hashes(codes, ORDER)
                    for n in range(1, ORDER + 1):
                        g = grams[n - 1][n - 1 :]
                        ctx = grams[n - 2][n - 2 : -1] if n > 1 else np.zeros(len(g), np.uint64)
                        tail = grams[n - 2][n - 1 :] if n > 1 else np.zeros(len(g), np.uint64)
                        if len(g):
                            for into, x in zip(rows, (np.full(len(g), n, np.int32), g, ctx, tail)):
                                into.append(x)
                if not rows[0]:
                    continue
                n, g, ctx, tail = map(np.concatenate, rows)
                _, first, count = np.unique(g, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(first)), pa.array(n[first]), *[pa.array(x[first].view(np.int64)) for x in (g, ctx, tail)], pa.array(count)],
                    names=["lang", "n", "gram", "context", "tail", "count"])

    parts = texts.mapInArrow(tidied(run), "lang string, n int, gram long, context long, tail long, count long")
    return parts.groupBy("lang", "n", "gram", "context", "tail").agg(F.sum("count").alias("count"))


def build(grams: dict[str, np.ndarray]) -> list[tuple]:
    """Kneser-Ney tables of one language from its n-grams: per order (gram hashes, probabilities, context hashes, weights)."""
    tables = []
    alphabet = max(1, int((grams["n"] == 1).sum()))
    for n in range(1, ORDER + 1):
        at = grams["n"] == n
        g, ctx = grams["gram"][at], grams["context"][at]
        if n < ORDER:
            # Continuation counts: the number of (n+1)-grams that end in this n-gram.
            tails, c = np.unique(grams["tail"][grams["n"] == n + 1], return_counts=True)
            count = _look(tails, c.astype(np.float64), g, 0.0)
        else:
            count = grams["count"][at].astype(np.float64)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.75
        names, where = np.unique(ctx, return_inverse=True)
        total = np.bincount(where, count, len(names))
        kinds = np.bincount(where, count > 0, len(names))
        total[total == 0] = 1
        prob = np.maximum(count - discount, 0) / total[where]
        weight = np.where(kinds > 0, discount * kinds / total, 1.0)
        order = np.argsort(g)
        tables.append((g[order], prob[order].astype(np.float32), names, weight.astype(np.float32)))
    tables.append(1.0 / (alphabet + 1))
    return tables


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """Values at the wanted keys of a sorted array."""
    if not len(keys):
        return np.full(len(wanted), missing, values.dtype)
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    return np.where(keys[i] == wanted, values[i], np.asarray(missing, values.dtype))


def _before(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at > 0, g[np.maximum(at - 1, 0)], U64(0))


def _bits(tables: list, grams: list, contexts: list) -> np.ndarray:
    """-log2 P(sign | signs before) for n-grams of every order and their contexts."""
    p = np.full(len(grams[0]), tables[-1])
    for n in range(1, ORDER + 1):
        g, prob, ctx, weight = tables[n - 1]
        c = np.zeros(len(p), np.uint64) if n == 1 else contexts[n - 2]
        p = _look(g, prob, grams[n - 1], 0.0) + _look(ctx, weight, c, 1.0) * p
    return -np.log2(p)


class Scorer:
    """Bits of each language for n-grams, kept between stretches: the n-grams of a language soon repeat."""

    def __init__(self, models: dict):
        self.names = sorted(models)
        self.models = models
        self.forget()

    def forget(self):
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(self.names)), np.float32)

    def bits(self, top: np.ndarray, grams: list, contexts: list) -> np.ndarray:
        """Rows of bits for sorted highest-order hashes; `grams` and `contexts` hold the lower orders at the same places."""
        i = np.minimum(np.searchsorted(self.keys, top), max(len(self.keys) - 1, 0))
        known = self.keys[i] == top if len(self.keys) else np.zeros(len(top), bool)
        new = ~known
        fresh = np.empty((int(new.sum()), len(self.names)), np.float32)
        for k, name in enumerate(self.names):
            fresh[:, k] = _bits(self.models[name], [g[new] for g in grams], [c[new] for c in contexts])
        out = np.empty((len(top), len(self.names)), np.float32)
        out[known] = self.values[i[known]]
        out[new] = fresh
        if len(self.keys) + len(fresh) > KEPT:
            self.forget()
        where = np.searchsorted(self.keys, top[new])
        self.keys = np.insert(self.keys, where, top[new])
        self.values = np.insert(self.values, where, fresh, axis=0)
        return out


def entropies(scorer: Scorer, data: np.ndarray, off: np.ndarray):
    """(signs per text, bits per sign of each language); a long text is scored in stretches that repeat the signs before."""
    n = len(off) - 1
    count, bits = np.zeros(n, np.int64), np.zeros((n, len(scorer.names)))
    for lo, hi in row_chunks(off, STRETCH):
        held, size = [], 0
        for k in range(lo, hi):
            codes = signs(data[off[k] : off[k + 1]].tobytes())[0]
            for s in range(1, max(len(codes), 1), STRETCH):
                lead, end = min(s, ORDER - 1), min(len(codes), s + STRETCH)
                held.append((k, lead, codes[s - lead : end]))
                size += end - s
                if size >= STRETCH:
                    _add(scorer, held, count, bits)
                    held, size = [], 0
        if held:
            _add(scorer, held, count, bits)
    return count, bits / np.maximum(count, 1)[:, None]


def _add(scorer: Scorer, pieces: list, count: np.ndarray, bits: np.ndarray) -> None:
    owner = np.concatenate([np.r_[np.full(lead, -1), np.full(len(x) - lead, k)] for k, lead, x in pieces])
    grams = [np.concatenate(g) for g in zip(*[gram_hashes(x, ORDER) for _, _, x in pieces])]
    top, first, back = np.unique(grams[-1], return_index=True, return_inverse=True)
    found = scorer.bits(top, [g[first] for g in grams], [_before(g, first) for g in grams])
    scored = owner >= 0
    who, back = owner[scored], back[scored]
    count += np.bincount(who, minlength=len(count))
    for i in range(found.shape[1]):
        bits[:, i] += np.bincount(who, found[back, i], len(count))


def fold(doc_id):
    """Remainder of crc32 of the id as text by 4; documents with remainder 2 are held out."""
    return crc32_of_id(doc_id) % 4


@dataclass
class LanguageModels:
    tables: dict
    temperature: float
    typical: dict  # language: (mean bits, variance between texts, variance per sign, limit)


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModels:
    """Models of the languages in `docs` (doc_id, text, lang); held-out documents and rows without a language are not read."""
    spark = docs.sparkSession
    prepare(spark)
    usable = docs.filter((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    space = 1 << 30
    # One number per language: the share of its texts that is drawn.
    share = {r[0]: min(space, space * sample // r[1]) for r in usable.groupBy("lang").agg(F.count(F.lit(1))).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(space))
    drawn = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair]) if share else F.create_map(F.lit(""), F.lit(0))
    chosen = usable.filter(draw < drawn[F.col("lang")])
    chosen = materialise(chosen.select("text", "lang", (F.pmod(F.xxhash64("doc_id", F.lit("held back")), F.lit(5)) == 0).alias("held_back")), "language_sample")
    grams = count_grams(chosen.filter(~F.col("held_back")).select("text", "lang")).toArrow()  # bounded by the sample
    tables = {}
    for lang in sorted(pc.unique(grams["lang"]).to_pylist()):
        part = grams.filter(pc.equal(grams["lang"], lang))
        tables[lang] = build({c: part[c].to_numpy() if c in ("n", "count") else part[c].to_numpy().view(np.uint64) for c in ("n", "count", "gram", "context", "tail")})
    model = LanguageModels(tables, 1.0, {lang: (0.0, 1.0, 1.0, math.inf) for lang in tables})
    if tables:
        calibrate(model, _raw(chosen.filter("held_back").select("text", "lang"), model, ["lang"]).toPandas())
    return model


def calibrate(model: LanguageModels, left_out) -> None:
    """Temperature by likelihood, and the limits of rejection, from texts left out of training."""
    names = sorted(model.tables)
    left_out = left_out[(left_out["__n"] > 0) & left_out["lang"].isin(names)]
    if not len(left_out):
        return
    h = np.array(left_out["__bits"].tolist()).reshape(len(left_out), len(names))
    right = left_out["lang"].map(names.index).to_numpy()
    n = left_out["__n"].to_numpy(float)

    def loss(t):
        z = -t * h
        z -= z.max(axis=1, keepdims=True)
        return -(z[np.arange(len(z)), right] - np.log(np.exp(z).sum(axis=1))).mean() + 1e-3 * math.log(t) ** 2

    model.temperature = float(min(2.0 ** np.arange(-2, 7, 0.5), key=loss))
    own = h[np.arange(len(h)), right]
    medians = {i: float(np.median(own[right == i])) for i in set(right)}
    apart = own - np.array([medians[i] for i in right])
    for i, lang in enumerate(names):
        some = right == i
        mean = medians[i] if i in medians else float(np.median(list(medians.values())))
        some = some if some.sum() >= FEW else np.ones(len(h), bool)
        between, sign = (_spread(d) ** 2 + 1e-6 for d in (apart[some], apart[some] * np.sqrt(n[some])))
        model.typical[lang] = (mean, between, sign, LIMIT)


def _spread(distances: np.ndarray) -> float:
    """Standard deviation of a normal distribution with this median distance."""
    return 1.4826 * float(np.median(np.abs(distances)))


def _raw(docs: DataFrame, model: LanguageModels, keep: list[str]) -> DataFrame:
    """(kept columns, n signs, bits of each language) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model.tables)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            data, off = string_buffers(batch.column("text"))
            count, bits = entropies(scorer, data, off)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(count), pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))],
                names=[*keep, "__n", "__bits"])

    own = [T.StructField("__n", T.LongType()), T.StructField("__bits", T.ArrayType(T.DoubleType()))]
    return docs.mapInArrow(tidied(run), T.StructType([*[docs.schema[c] for c in keep], *own]))


OWN = ("lang_pred", "score", "bits_per_sign", "rejected")


def _judged(docs: DataFrame, model: LanguageModels, keep: list[str]) -> DataFrame:
    """The columns `keep` under the names __k0, __k1 and so on, with __lang, __score, __per_sign and __rejected."""
    prepare(docs.sparkSession)
    given = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    hidden = [f"__k{i}" for i in range(len(keep))]
    names = sorted(model.tables)
    if not names:
        return docs.select(*given, F.lit("und").alias("__lang"), F.lit(0.0).alias("__score"), F.lit(None).cast("double").alias("__per_sign"), F.lit(True).alias("__rejected"))
    raw = _raw(docs.select("text", *given), model, hidden)
    best = F.array_min("__bits")
    who = F.array_position("__bits", best)
    total = F.aggregate("__bits", F.lit(0.0), lambda acc, b: acc + F.exp(F.lit(model.temperature) * (best - b)))
    at = lambda k: F.element_at(F.array(*[F.lit(float(model.typical[x][k])) for x in names]), who.cast("int"))
    far = (best - at(0)) / F.sqrt(at(1) + at(2) / F.greatest(F.col("__n"), F.lit(1))) > at(3)
    some = F.col("__n") > 0
    return raw.select(
        *hidden, F.when(some, F.element_at(F.array(*[F.lit(x) for x in names]), who.cast("int"))).otherwise("und").alias("__lang"),
        F.when(some, 1 / total).otherwise(0.0).alias("__score"), F.when(some, best).alias("__per_sign"), F.when(some, far).otherwise(True).alias("__rejected"))


def predict(docs: DataFrame, model: LanguageModels, keep: list[str]) -> DataFrame:
    """Columns `keep` with lang_pred, score, bits_per_sign and rejected; only the text is read for the prediction.

    A kept column must not have one of these four names (`accepted` takes any columns).
    """
    if clash := sorted(set(keep) & set(OWN)):
        raise ValueError(f"columns of the prediction's own names: {clash}")
    judged = _judged(docs, model, keep)
    own = [F.col(c).alias(n) for c, n in zip(("__lang", "__score", "__per_sign", "__rejected"), OWN)]
    return judged.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *own)


def accepted(docs: DataFrame, model: LanguageModels) -> DataFrame:
    """The rows of `docs` that the models do not reject, with exactly the columns of `docs`, whatever their names."""
    judged = _judged(docs, model, docs.columns).filter(~F.col("__rejected"))
    return judged.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)])


@register("op8_language_models")
def op8_language_models(spark, sf_dir):
    """Predicted language of every document."""
    docs = load(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), train(docs), ["doc_id"])
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_sign", "rejected")
