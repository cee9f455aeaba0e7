"""Scoring of texts with a log-bilinear neural language model.

Words are counted over all training rows by Spark. The ``TOP`` most frequent words are outputs of
their own; every other word belongs to one of ``TAILS`` classes by its last two bytes, and inside its
class it has its add-one share of the counts. The end of a text is an output too. A token's context is
the outputs of the two tokens before it: the model predicts a vector, the sum of each one's embedding
times a matrix for its place, and a token's score is that vector's product with the token's output
embedding plus a bias.

Every text is encoded once: its outputs are written as an array of two bytes a token, and training and
scoring read those arrays. Training is noise-contrastive, in numpy, on every training token: in each of
``ROUNDS`` rounds tasks train on their own rows of that round, once, in batches of ``BATCH``, starting from the shared parameters. Rows are dealt to tasks of about ``TASK_TOKENS`` tokens by
a hash of their number, so a large table has more tasks and the same schedule in each. What the tasks
learnt is averaged, weighted by tokens, in a tree of at most ``FAN`` parameter vectors a task. Parameters
have a fixed size.

Scoring is normalised exactly: batched matrix products give the logarithm of the sum over all outputs
for every context, once, in Spark; the sum of a token's two products is read from two tables. What a
class gives to its words needs each word's count. The ``LOCAL`` most frequent words' counts are
broadcast (a fixed bound); the others are looked up by a join, so any vocabulary is counted in full.

Defined results: a null text is an empty one and has only its end; words that training rows do not hold
have count 0 and take the unknown share of their class; with no training rows both scores follow from
empty counts; repeated rows are repeated in the result; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, lower_ascii, materialise, ship, text_chunks

TOP, TAILS, DIM = 1500, 192, 24
LOCAL = 1 << 17
ROUNDS, BATCH, NOISE, RATE = 2, 512, 48, 0.1
TASK_TOKENS, FAN = 2_000_000, 32
SEED = 11
N_OUT = 1 + TOP + TAILS


def words_of(text: str | None) -> list[bytes]:
    """Splitting bytes parts them at runs of 20 and 09-0D."""
    return lower_ascii(text or "").split()


def tail_class(word: bytes) -> int:
    return 1 + TOP + zlib.crc32(word[-2:]) % TAILS


@dataclass
class Vocabulary:
    """Counts of the frequent words, totals of all; ``output`` of a local word and log10(count + 1)."""

    tokens: int
    types: int
    place: dict[bytes, int]
    output: np.ndarray
    log_count: np.ndarray
    class_size: np.ndarray
    output_count: np.ndarray
    end_log_count: float


def count_words(train: DataFrame) -> DataFrame:
    """word and n over all rows, combined in each task first; the empty word counts the rows."""
    ship(train.sparkSession)

    def run(batches):
        seen: Counter = Counter()
        for pdf in batches:
            seen[b""] += len(pdf)
            for text in pdf["text"]:
                seen.update(words_of(text))
                if len(seen) > 200_000:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return train.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cutoff(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` words reach."""
    left = most
    least = 1
    by_n = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).limit(most + 1)
    for r in by_n.toLocalIterator():
        if r["words"] > left:
            return max(least, r["n"] + 1)
        left -= r["words"]
    return least


def vocabulary(counts: DataFrame) -> Vocabulary:
    """``counts`` is what :func:`count_words` returns, materialised."""
    rows = counts.where(F.octet_length("word") == 0).first()
    texts, counts = rows["n"] if rows else 0, counts.where(F.octet_length("word") > 0)
    tail = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS)).cast("int")
    held = counts.where(F.col("n") >= _cutoff(counts, LOCAL)).toArrow()
    local = sorted(zip((-held["n"].to_numpy()).tolist(), held["word"].to_pylist(), strict=True))
    place = {w: k for k, (_, w) in enumerate(local)}
    n = np.array([-c for c, _ in local], np.int64)
    output = np.array([1 + k if k < TOP else tail_class(w) for k, (_, w) in enumerate(local)] + [0], np.int16)
    by_class = counts.groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    tokens, types = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in by_class:
        tokens[r["tail"]], types[r["tail"]] = r["n"], r["types"]
    total, kinds = int(tokens.sum()), int(types.sum())
    for k, (c, w) in enumerate(local[:TOP]):  # these are outputs of their own, not part of their class
        tokens[tail_class(w) - 1 - TOP] += c
        types[tail_class(w) - 1 - TOP] -= 1
    heads = np.zeros(TOP, np.int64)
    heads[: min(TOP, len(n))] = n[:TOP]
    return Vocabulary(total + texts, kinds + (texts > 0), place, output, np.append(np.log10(n + 1.0), [0.0, 0.0]), np.log10(tokens + types + 1.0), np.concatenate(([texts], heads, tokens)), math.log10(texts + 1.0))


def encode(texts: list[str | None], vocab: Vocabulary, tails: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Outputs of all words and ends, places of the words (-1: not local, -2: an end), tokens by text, the words that are not local."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    word = np.ones(int(sizes.sum()), bool)
    word[ends] = False
    at, out = np.full(len(word), -2, np.int32), np.zeros(len(word), np.int16)
    at[word] = np.fromiter(map(vocab.place.get, chain.from_iterable(words), repeat(-1)), np.int32, len(word) - len(words))
    out[word] = vocab.output[at[word]]
    rare: list[list[bytes]] = [[] for _ in words]
    rest = np.flatnonzero(at == -1)
    doc = np.searchsorted(ends, rest)
    for k, d, i in zip(rest.tolist(), doc.tolist(), (rest - ends[doc] + sizes[doc] - 1).tolist(), strict=True):
        w = words[d][i]
        rare[d].append(w)
        end = w[-2:]
        if end not in tails:
            tails[end] = tail_class(end)
        out[k] = tails[end]
    return out, at, sizes, rare


def _contexts(outs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second context and token, over all texts; a text starts after ends (output 0)."""
    if not outs:
        return (np.zeros(0, np.int16),) * 3
    start = np.zeros(2, np.int16)
    padded = np.concatenate([x for o in outs for x in (start, o)])
    sizes = np.fromiter((len(o) for o in outs), np.int64, len(outs))
    token = np.ones(len(padded), bool)
    first = np.cumsum(sizes + 2) - sizes - 2
    token[first] = token[first + 1] = False
    at = np.flatnonzero(token)
    return padded[at - 2], padded[at - 1], padded[at]


class Model:
    """Parameters as one vector, so that they can be averaged place by place. An outer row ends with its bias."""

    SHAPES = [("inner", (N_OUT, DIM)), ("outer", (N_OUT, DIM + 1)), ("first", (DIM, DIM)), ("second", (DIM, DIM))]
    SIZE = sum(math.prod(s) for _, s in SHAPES)

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat.astype(np.float32), 0
        for name, shape in self.SHAPES:
            n = math.prod(shape)
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, output_count: np.ndarray) -> Model:
        rng = np.random.default_rng(SEED)
        model = cls(rng.normal(0, 0.1, cls.SIZE))
        share = (output_count + 0.5) / (output_count + 0.5).sum()
        model.first[:], model.second[:] = 0.5 * np.eye(DIM), 0.5 * np.eye(DIM)
        model.outer[:, DIM] = np.log(share)
        return model

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Product of each (context, output), for either place; the bias is in the second."""
        vectors, bias = self.outer[:, :DIM], self.outer[:, DIM]
        return self.inner @ self.first @ vectors.T, self.inner @ self.second @ vectors.T + bias


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and their sums of values; 16-bit rows are sorted by radix."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    last = np.flatnonzero(np.concatenate((rows[1:] != rows[:-1], [True])))
    sums = np.cumsum(values[order], axis=0)[last]
    sums[1:] -= sums[:-1].copy()
    return rows[last], sums


class Trainer:
    """Noise-contrastive estimation with AdaGrad. The noise is the outputs' share of the training tokens."""

    def __init__(self, model: Model, output_count: np.ndarray, rng: np.random.Generator):
        self.m, self.rng = model, rng
        share = (output_count + 0.5) / (output_count + 0.5).sum()
        self.log_noise, self.steps = (np.log(share) + math.log(NOISE)).astype(np.float32), np.cumsum(share)
        self.seen = {name: np.full(shape, 1e-2, np.float32) for name, shape in Model.SHAPES}

    def _move(self, name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        own, seen = getattr(self.m, name), self.seen[name]
        total = seen[rows] + grad * grad
        seen[rows] = total
        own[rows] -= np.float32(RATE) * grad / np.sqrt(total)

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        m, n = self.m, len(w)
        noise = np.searchsorted(self.steps, self.rng.random(NOISE)).clip(0, N_OUT - 1).astype(np.int16)
        ra, rb, rw, rn = m.inner[a], m.inner[b], m.outer[w], m.outer[noise]
        q = np.ones((n, DIM + 1), np.float32)
        q[:, :DIM] = ra @ m.first + rb @ m.second
        real = (q * rw).sum(1) - self.log_noise[w]
        fake = q @ rn.T - self.log_noise[noise]
        g_real = np.float32(-1 / n) / (1 + np.exp(np.clip(real, -30, 30)))
        np.exp(np.clip(-fake, -30, 30, out=fake), out=fake)
        g_fake = np.float32(1 / n) / (1 + fake)
        dq = np.ascontiguousarray((g_real[:, None] * rw + g_fake @ rn)[:, :DIM])
        outer = _by_row(np.concatenate((w, noise)), np.concatenate((g_real[:, None] * q, g_fake.T @ q)))
        inner = _by_row(np.concatenate((a, b)), np.concatenate((dq @ m.first.T, dq @ m.second.T)))
        d_first, d_second = ra.T @ dq, rb.T @ dq
        self._move("outer", outer[1], outer[0])
        self._move("inner", inner[1], inner[0])
        self._move("first", d_first)
        self._move("second", d_second)


def _mean(batches):
    """One weighted mean of parameter vectors."""
    total, tokens = np.zeros(Model.SIZE), 0
    for pdf in batches:
        for flat, n in zip(pdf["flat"], pdf["tokens"], strict=True):
            total += np.frombuffer(flat, np.float32) * float(n)
            tokens += n
    if tokens:
        yield pd.DataFrame({"flat": [(total / tokens).astype(np.float32).tobytes()], "tokens": [tokens]})


def train(coded: DataFrame, output_count: np.ndarray, tokens: int) -> Model:
    """``coded``: row and outs of the training rows. Every row trains in the round that its number's hash names."""
    spark = coded.sparkSession
    ship(spark)
    model = Model.start(output_count)
    parts = max(1, -(-tokens // (ROUNDS * TASK_TOKENS)))
    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast((model.flat, output_count))

        def run(batches, now=now, k=k):
            flat, counts = now.value
            outs = [np.frombuffer(o, np.int16) for pdf in batches for o in pdf["outs"]]
            a, b, w = _contexts(outs)
            if not len(w):
                return
            trainer = Trainer(Model(flat.copy()), counts, np.random.default_rng([SEED, k]))
            order = trainer.rng.permutation(len(w))
            for s in range(0, len(w), BATCH):
                take = order[s : s + BATCH]
                trainer.step(a[take], b[take], w[take])
            yield pd.DataFrame({"flat": [trainer.m.flat.tobytes()], "tokens": [len(w)]})

        kind = "flat binary, tokens long"
        mine = coded.where(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == k).select("outs", F.xxhash64("row", F.lit(1)).alias("deal"))
        learnt, n = mine.repartition(parts, "deal").select("outs").mapInPandas(run, kind), parts
        while n > FAN:
            n = -(-n // FAN)
            learnt = learnt.repartition(n).mapInPandas(_mean, kind)
        rows = learnt.collect()  # at most FAN vectors
        if rows:
            mean = next(_mean([pd.DataFrame({"flat": [bytes(r["flat"]) for r in rows], "tokens": [r["tokens"] for r in rows]})]))
            model = Model(np.frombuffer(mean["flat"][0], np.float32))
    return model


def log_sums(spark, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log of the sum of exp over all outputs, for each pair of contexts: Spark does blocks of rows."""
    shared = spark.sparkContext.broadcast(tables)

    def run(batches):
        one, two = shared.value
        top = two.max(1)
        scaled = np.exp(two - top[:, None])
        for pdf in batches:
            for block in np.array_split(pdf["id"].to_numpy(), max(1, -(-len(pdf) // 128))):
                peak = one[block].max(1)
                sums = np.exp(one[block] - peak[:, None]) @ scaled.T
                z = np.log(np.maximum(sums, 1e-30)) + peak[:, None] + top[None, :]
                yield pd.DataFrame({"a": block, "z": [r.tobytes() for r in z.astype(np.float32)]})

    out = np.zeros((N_OUT, N_OUT), np.float32)
    for r in spark.range(0, N_OUT, 1, 12).mapInPandas(run, "a long, z binary").toLocalIterator():
        out[r["a"]] = np.frombuffer(r["z"], np.float32)
    return out


def encoded(docs: DataFrame, is_held, vocab: Vocabulary) -> DataFrame:
    """Every row once: its outputs, and the parts of its scores that need no model. Written, so that row numbers stay."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocab)

    def run(batches):
        voc = known.value
        tails: dict[bytes, int] = {}
        for pdf in batches:
            texts, ids, helds = pdf["text"].tolist(), pdf["doc_id"].to_numpy(), pdf["held_out"].to_numpy()
            for x, y in text_chunks(texts, 3_000_000):
                w, at, sizes, rare = encode(texts[x:y], voc, tails)
                count = np.where(at >= 0, voc.log_count[at], 0.0)
                count[at == -2] = voc.end_log_count
                share = np.where(w > TOP, count - voc.class_size[np.maximum(w - 1 - TOP, 0)], 0.0)
                first = np.cumsum(sizes) - sizes
                yield pd.DataFrame({
                    "doc_id": ids[x:y], "held_out": helds[x:y], "n_tokens": sizes,
                    "n_local": np.add.reduceat((at >= 0).astype(np.int64), first) + (voc.end_log_count > 0),
                    "counts": np.add.reduceat(count, first), "share": np.add.reduceat(share, first),
                    "rare": rare, "outs": [w[f : f + n].tobytes() for f, n in zip(first.tolist(), sizes.tolist(), strict=True)],
                })

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), is_held.alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = "doc_id string, held_out boolean, n_tokens long, n_local long, counts double, share double, rare array<binary>, outs binary"
    return materialise(rows.mapInPandas(run, kind).withColumn("row", F.monotonically_increasing_id()), "lm-coded")


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    ship(spark)
    is_held = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds)) == held
    counts = materialise(count_words(docs.where(~is_held)), "word-counts")
    vocab = vocabulary(counts)
    coded = encoded(docs, is_held, vocab)
    model = train(coded.where("not held_out").select("row", "outs"), vocab.output_count, vocab.tokens)
    tables = model.tables()
    scored = spark.sparkContext.broadcast((*tables, log_sums(spark, tables)))

    def run(batches):
        one, two, sums = scored.value
        for pdf in batches:
            outs = [np.frombuffer(o, np.int16) for o in pdf["outs"]]
            for x, y in text_chunks(outs, 1_000_000):
                a, b, w = _contexts(outs[x:y])
                sizes = np.fromiter((len(o) for o in outs[x:y]), np.int64, y - x)
                logp = (one[a, w] + two[b, w] - sums[a, b]).astype(np.float64) / math.log(10)
                yield pd.DataFrame({"row": pdf["row"].iloc[x:y].to_numpy(), "logp": np.add.reduceat(logp, np.cumsum(sizes) - sizes)})

    light = coded.select("row", "doc_id", "held_out", "n_tokens", "n_local", "counts", "share")
    rare = coded.select("row", F.explode("rare").alias("word"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count(F.lit(1)).alias("n_more"))
    out = light.join(coded.select("row", "outs").mapInPandas(run, "row long, logp double"), "row").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    base = F.col("counts") + more - F.col("n_tokens") * math.log10(vocab.tokens + vocab.types + 1)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", (F.col("n_local") + F.coalesce("n_more", F.lit(0))).cast("long").alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("logp") + F.col("share") + more).alias("score"))
