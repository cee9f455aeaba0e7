"""Language identification of whole texts, with the spans of mixed-language text.

Script ranges narrow the languages that a word can be in; character trigrams of the word score those
that are left; Viterbi with a fixed penalty for changing language turns the word scores into spans.

The model is learnt by Spark from all labelled rows given to :func:`train`: counts of hashed trigrams
and of letters by script, per language. Its size is (languages) x (``BUCKETS`` + scripts), whatever
the corpus holds. Tasks count distinct words first and send one row per used bucket.

Defined results: a null or letterless text (signs and digits of any kind) is ``und`` with score 0 and no spans, as is every text if
no row is labelled; rows with a null text or language do not train; languages that tie are taken in
alphabetical order; a word in a script that no training row used may be in any language; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, ship, text_chunks

UNKNOWN = "und"
BUCKETS = 1 << 15
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script that has at least this share of its letters.
SCRIPT_SHARE = 0.001
WORD = re.compile(r"[^\W\d_]+")
#: First code point of each range and its script.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han")]
_STARTS = [s for s, _ in SCRIPTS]
_NAMES = sorted({n for _, n in SCRIPTS})
_INDEX = [_NAMES.index(n) for _, n in SCRIPTS]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words' trigrams with their ends marked, one word after another; each word's first place; its script."""
    points = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 2)
    with np.errstate(over="ignore"):
        mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    inside = np.ones(len(points), bool)
    inside[ends - 1] = inside[ends - 2] = False
    scripts = np.asarray(_INDEX)[np.searchsorted(_STARTS, points[ends - sizes - 1], side="right") - 1]
    return (mixed[inside[:-2]] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.cumsum(sizes) - sizes, scripts


class Model:
    """Log-probabilities by language, and the languages that use each script."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        counts = np.zeros((len(self.langs), BUCKETS + len(_NAMES)))
        for lang, bucket, n in rows:
            counts[self.langs.index(lang), bucket] += n
        seen, letters = counts[:, :BUCKETS], counts[:, BUCKETS:]
        self.logp = np.log((seen + 0.5) / (seen.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32).T.copy()
        share = letters / np.maximum(letters.sum(1, keepdims=True), 1)
        self.uses = (share >= SCRIPT_SHARE).T
        self.uses[~self.uses.any(1)] = True

    def score(self, words: list[str]) -> np.ndarray:
        buckets, first, scripts = grams(words)
        return np.where(self.uses[scripts], np.add.reduceat(self.logp[buckets], first, axis=0), np.float32(-1e6))


def train(rows: DataFrame) -> Model:
    """A model of the rows' text and lang."""
    ship(rows.sparkSession)

    def table(words: dict[str, Counter]):
        for lang, seen in words.items():
            out = np.zeros(BUCKETS + len(_NAMES), np.int64)
            if not seen:
                continue
            known, times = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
            buckets, first, scripts = grams(known)
            letters = np.diff(np.append(first, len(buckets)))
            out[:BUCKETS] = np.bincount(buckets, np.repeat(times, letters), BUCKETS)
            out[BUCKETS:] = np.bincount(scripts, times * letters, len(_NAMES))
            at = np.flatnonzero(out)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": out[at]})

    def run(batches):
        words: dict[str, Counter] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
                if sum(map(len, words.values())) > 400_000:
                    yield from table(words)
                    words = {}
        yield from table(words)

    known = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = known.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model([(r["lang"], r["bucket"], r["n"]) for r in counts.collect()])


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of each word; ``sizes`` are the numbers of words of successive texts.

    All texts advance together, one word at a time, longest first, so a step is one array operation
    over the texts that still have words.
    """
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    v = scores[first[: alive[0]]].astype(np.float64)
    moved, came = [], []
    for t in range(1, sizes[0]):
        n = alive[t]
        old = v[:n]
        best = old.argmax(1)
        jump = old[np.arange(n), best] - penalty
        switch = jump[:, None] > old
        moved.append(switch)
        came.append(best)
        v[:n] = np.where(switch, jump[:, None], old) + scores[first[:n] + t]
    now = v.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        n = alive[t]
        labels[first[:n] + t] = now[:n]
        if t:
            switch = moved[t - 1][np.arange(n), now[:n]]
            now[:n] = np.where(switch, came[t - 1], now[:n])
    return labels


def stays(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> int:
    """The language that the best path never leaves, or -1 if that is not certain.

    A stretch in another language gains at most the largest sum of consecutive score differences. A path
    of k such stretches has k - 1 changes or more, and k or more if it is ever in the best language, so
    if no such sum reaches half the penalty every other path loses.
    """
    best = int(scores.sum(0, dtype=np.float64).argmax())
    run = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate((np.zeros((1, run.shape[1])), run[:-1])), axis=0)
    return best if 2 * (run - low).max() < penalty else -1


def label_words(scores: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """As :func:`viterbi`, which is run only for texts that may change language."""
    ends = np.cumsum(sizes)
    one = np.array([stays(scores[e - n : e], penalty) if n else -1 for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], np.int64)
    labels = np.repeat(one, sizes)
    open_texts = np.flatnonzero(one < 0)
    if len(open_texts):
        rows = labels < 0
        labels[rows] = viterbi(scores[rows], sizes[open_texts], penalty)
    return labels


class _Words(dict):
    """Word to row of ``scores``; words seen for the first time get the next rows and are scored together."""

    def __init__(self, model: Model):
        self.model, self.fresh = model, []
        self.scores, self.letters = np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.fresh.append(word)
        return k

    def settle(self) -> None:
        if self.fresh:
            self.scores = np.concatenate((self.scores, self.model.score(self.fresh).astype(np.float32)))
            self.letters = np.concatenate((self.letters, np.fromiter(map(len, self.fresh), np.int64, len(self.fresh))))
            self.fresh = []


def label_texts(texts: list[str | None], model: Model, cache: _Words) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """Language, share of letters in it and spans (language, first word, words) of each text."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    words = [ws if any(c.isalpha() for w in ws for c in w) else [] for ws in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n, total = len(model.langs), int(sizes.sum())
    if not n or not total:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    rows = np.concatenate([np.array(list(map(cache.__getitem__, ws)), np.int64) for ws in words])
    cache.settle()
    letters = cache.letters[rows]
    labels = label_words(cache.scores[rows], sizes)
    doc = np.repeat(np.arange(len(words)), sizes)
    by = np.bincount(doc * n + labels, weights=letters, minlength=len(words) * n).reshape(-1, n)
    best, share = by.argmax(1), by.max(1) / np.maximum(by.sum(1), 1)
    turn = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
    long = np.diff(np.concatenate((turn, [total])))
    start = turn - (np.cumsum(sizes) - sizes)[doc[turn]]
    spans: list[list[tuple[str, int, int]]] = [[] for _ in words]
    for d, lab, a, k in zip(doc[turn].tolist(), labels[turn].tolist(), start.tolist(), long.tolist(), strict=True):
        spans[d].append((model.langs[lab], a, k))
    return [(model.langs[b], float(s), sp) if z else (UNKNOWN, 0.0, []) for b, s, sp, z in zip(best, share, spans, sizes, strict=True)]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans of every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        cache = _Words(shared.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in text_chunks(texts, 3_000_000):
                if len(cache) > 300_000:
                    cache = _Words(shared.value)
                found = label_texts(texts[a:b], shared.value, cache)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].to_numpy(), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "spans": [[{"lang": x, "first_word": y, "n_words": z} for x, y, z in f[2]] for f in found]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInPandas(run, "doc_id string, lang_pred string, score double, spans array<struct<lang:string,first_word:int,n_words:int>>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def learning_rows(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    return docs.where(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds)) != held)


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans; learns from the rows that are not held out."""
    model = train(learning_rows(docs, folds, held))
    return predict(docs, model).withColumn("held_out", F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds)) == held)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose text has a language: texts without a letter go."""
    n = "__langid_"
    model = train(learning_rows(docs))
    out = predict_beside(docs, model, f"{n}pred").where(F.col(f"{n}pred") != UNKNOWN)
    return out.select(*docs.columns)


def predict_beside(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """The documents with their language in column ``name``; a Pandas UDF beside the other columns."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def lang_of(batches: pd.Series) -> pd.Series:
        cache, out, texts = _Words(shared.value), [], batches.tolist()
        for a, b in text_chunks(texts, 3_000_000):
            if len(cache) > 300_000:
                cache = _Words(shared.value)
            out += [f[0] for f in label_texts(texts[a:b], shared.value, cache)]
        return pd.Series(out, dtype=object)

    return docs.withColumn(name, lang_of(F.col("text").cast("string")))
