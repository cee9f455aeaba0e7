"""Line deduplication with a sharded minimal perfect hash.

A line's key is the line without blanks at its ends and with A-Z lower-cased. Keys that at least
``min_docs`` documents hold lose their lines in every document; other lines stay.

1. Tasks hash each document's distinct keys to a place and an independent 64-bit fingerprint; Spark
   counts documents per (place, fingerprint), combined before the shuffle.
2. The hashes of all distinct keys are dealt to shards of about ``SHARD_KEYS`` keys by their high bits. Each shard builds a
   minimal perfect hash: keys fall into small buckets and every bucket stores the seed that sends its
   keys to free cells. What is kept is the seeds, a fingerprint and a count per cell, no keys.
3. Documents probe the arrays. A text sends the hashes of its distinct keys, 32 bytes each, to the shards; the counts found there
   decide, and the numbers of dropped lines go back to the text. Shards to which more than ``LINES_PER_TASK``
   hashes can come, such as that of a line which most documents hold, are copied and their hashes shared out among the copies;
   the sums of the shards' counts tell which. Nothing is broadcast or sent to the driver, at any size.

Defined results: a null or empty text is one empty line, and keys shorter than ``min_chars`` code
points never drop; a document whose lines all drop has an empty text; a line repeated in one document
counts once for it; repeated rows are documents of their own; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialise, ship, text_chunks

MIN_DOCS, MIN_CHARS = 10, 1
SHARD_KEYS = 100_000
LINES_PER_TASK = 1_000_000
#: A task forgets which texts it has sent after so many; sending one again changes nothing.
_REMEMBERED = 200_000
_PLACE, _FINGER = 1, 2
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def line_keys(text: str | None) -> list[bytes]:
    return [line.strip(BLANKS).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _mix(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (multiply, shift, exclusive-or)."""
    with np.errstate(over="ignore"):
        x = (x ^ (seed.astype(np.uint64) * _GOLDEN)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def build_shard(place: np.ndarray, finger: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds by bucket, then fingerprints and counts by cell. ``place`` values are distinct."""
    n = len(place)
    buckets = max(1, n // 3)
    where = (_mix(place, np.zeros(1, np.uint64)) % np.uint64(buckets)).astype(np.int64)
    seeds = np.zeros(buckets, np.int32)
    taken = np.zeros(n, bool)
    cell_of = np.zeros(n, np.int64)
    order = np.argsort(where, kind="stable")
    sizes = np.bincount(where, minlength=buckets)
    first = np.cumsum(sizes) - sizes
    tries = np.arange(1, 65, dtype=np.uint64)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        members = order[first[b] : first[b] + sizes[b]]
        base = 0
        while True:
            cells = (_mix(place[members][:, None], tries[None, :] + np.uint64(base)) % np.uint64(n)).astype(np.int64)
            free = ~taken[cells].any(0)
            if sizes[b] > 1:
                in_order = np.sort(cells, axis=0)
                free &= (in_order[1:] != in_order[:-1]).all(0)
            good = np.flatnonzero(free)
            if len(good):
                pick = cells[:, good[0]]
                seeds[b] = base + good[0] + 1
                taken[pick] = True
                cell_of[members] = pick
                break
            base += len(tries)
    fingers, counts = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    fingers[cell_of], counts[cell_of] = finger, count
    return seeds, fingers, counts


def probe(shard: tuple[np.ndarray, ...], place: np.ndarray, finger: np.ndarray) -> np.ndarray:
    """The count of each hash, 0 where the fingerprint differs."""
    seeds, fingers, counts, *extra = shard
    if not len(fingers):
        return np.zeros(len(place), np.int64)
    b = (_mix(place, np.zeros(1, np.uint64)) % np.uint64(len(seeds))).astype(np.int64)
    cell = (_mix(place, seeds[b].astype(np.uint64)) % np.uint64(len(fingers))).astype(np.int64)
    out = np.where(fingers[cell] == finger, counts[cell], 0)
    for f, n in extra[0].T.tolist() if extra else ():
        out[(finger == np.uint64(f)) & (out == 0)] = n
    return out


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k, _PLACE) for k in keys), np.uint64, len(keys)), np.fromiter((digest(k, _FINGER) for k in keys), np.uint64, len(keys))


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key.decode("utf-8", "surrogatepass")) >= min_chars


def key_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """place, finger and n, the documents that hold the key, over the whole table."""
    ship(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in text_chunks(texts):
                keys = [k for t in texts[a:b] for k in set(line_keys(t)) if _long_enough(k, min_chars)]
                place, finger = _hashes(keys)
                yield pd.DataFrame({"place": place.view(np.int64), "finger": finger.view(np.int64)})

    return docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "place long, finger long").groupBy("place", "finger").agg(F.count(F.lit(1)).alias("n"))


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """shard, n, load, seeds, fingers, counts: one row of arrays for each shard that has keys. ``load`` is the sum of its counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place, finger = pdf["place"].to_numpy().view(np.uint64), pdf["finger"].to_numpy().view(np.uint64)
        counts = pdf["n"].to_numpy()
        # keys that share a place hash with another (at most a few in 10^9) are kept in a plain list
        keep = np.unique(place, return_index=True)[1]
        rest = np.setdiff1d(np.arange(len(place)), keep)
        seeds, fingers, n = build_shard(place[keep], finger[keep], counts[keep])
        extra = np.stack([finger[rest], counts[rest].astype(np.uint64)])
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [len(place)], "load": [int(counts.sum())], "seeds": [seeds.tobytes()], "fingers": [fingers.tobytes()], "counts": [n.tobytes()], "extra": [extra.tobytes()]})

    sharded = counts.withColumn("shard", F.pmod(F.shiftrightunsigned("place", 32), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(run, "shard int, n long, load long, seeds binary, fingers binary, counts binary, extra binary")


def _arrays(row) -> tuple[np.ndarray, ...]:
    return np.frombuffer(row["seeds"], np.int32), np.frombuffer(row["fingers"], np.uint64), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["extra"], np.uint64).reshape(2, -1)


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, lines_per_task: int = LINES_PER_TASK) -> DataFrame:
    """doc_id, text (rewritten), n_lines, n_dropped of every row."""
    counts = materialise(key_counts(docs, min_chars), "line-counts")
    shards = max(1, -(-counts.count() // shard_keys))
    index = materialise(build_index(counts, shards), "line-index")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _rewrite(rows, index, shards, min_docs, lines_per_task).withColumn("doc_id", F.col("doc_id").cast("long"))


def _sent(keyed: DataFrame, shards: int) -> DataFrame:
    """k1, k2, line, place, finger, shard: the first line of each distinct key of each text, once per task however many rows hold the text."""

    def hashes(batches):
        seen = set()
        for pdf in batches:
            new = []
            for at, pair in enumerate(zip(pdf["k1"].tolist(), pdf["k2"].tolist(), strict=True)):
                if pair not in seen:
                    seen.add(pair)
                    new.append(at)
            if len(seen) > _REMEMBERED:
                seen.clear()
            texts = pdf["text"].iloc[new].tolist()
            for a, b in text_chunks(texts):
                part = pdf.iloc[new[a:b]]
                firsts = []
                for text in texts[a:b]:
                    first: dict[bytes, int] = {}
                    for line, key in enumerate(line_keys(text)):
                        first.setdefault(key, line)
                    firsts.append(first)
                n = [len(f) for f in firsts]
                place, finger = _hashes([k for f in firsts for k in f])
                lines = np.fromiter((line for f in firsts for line in f.values()), np.int32, sum(n))
                yield pd.DataFrame({"k1": np.repeat(part["k1"].to_numpy(), n), "k2": np.repeat(part["k2"].to_numpy(), n), "line": lines, "place": place.view(np.int64), "finger": finger.view(np.int64)})

    lines = keyed.select("k1", "k2", "text").mapInPandas(hashes, "k1 long, k2 long, line int, place long, finger long")
    return lines.withColumn("shard", F.pmod(F.shiftrightunsigned("place", 32), F.lit(shards)).cast("int"))


def _shared_out(lines: DataFrame, index: DataFrame, lines_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Both with a ``salt``: a shard with a load above the bound has as many copies as its load asks for, others have one."""
    salts = F.ceil(F.col("load") / lines_per_task).cast("int")
    heavy = index.where(F.col("load") > lines_per_task).select("shard", salts.alias("salts"))
    lines = lines.join(heavy, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("k1", "k2"), F.coalesce("salts", F.lit(1))).cast("int"))
    return lines.drop("salts"), index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))


def _rewrite(rows: DataFrame, index: DataFrame, shards: int, min_docs: int, lines_per_task: int) -> DataFrame:
    def look(pdf_lines: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(arrays) or not len(pdf_lines):
            return pdf_lines.head(0)[["k1", "k2", "line"]]
        n = probe(_arrays(arrays.iloc[0]), pdf_lines["place"].to_numpy().view(np.uint64), pdf_lines["finger"].to_numpy().view(np.uint64))
        return pdf_lines.loc[n >= min_docs, ["k1", "k2", "line"]]

    def rewrite(batches):
        for pdf in batches:
            out = []
            for text, gone in zip(pdf["text"], pdf["gone"], strict=True):
                lines = (text or "").split("\n")
                kept = lines
                if gone is not None:
                    keys = line_keys(text)
                    drop = {keys[k] for k in gone}
                    kept = [line for line, key in zip(lines, keys, strict=True) if key not in drop]
                out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "text": [o[0] for o in out], "n_lines": [o[1] for o in out], "n_dropped": [o[2] for o in out]})

    keyed = rows.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(7), "text"))
    lines, copies = _shared_out(_sent(keyed, shards), index, lines_per_task)
    gone = lines.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(look, "k1 long, k2 long, line int")
    gone = gone.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"))
    return keyed.join(gone, ["k1", "k2"], "left").select("doc_id", "text", "gone").mapInPandas(rewrite, "doc_id string, text string, n_lines long, n_dropped long")
