"""Small documents with everything that may go wrong, and the plain rules that operators are held against."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must do no harm.
CLASHES = ["digest", "norm", "fp", "shard", "slot", "row", "words", "block", "keep_id", "text_sha256", "component_id", "salt", "at", "cell"]

BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box under a pale moon tonight and nobody minds at all"
ITEM = "every benchmark question holds words that no honest training text should repeat in the same order as it stands written here"


def awkward() -> list[tuple]:
    long = " ".join(f"w{i % 97}{chr(97 + i % 13)}" for i in range(6000))
    rows = [
        (0, BASE, "en", "a", 1), (1, BASE.replace(" ", "  "), "en", "a", None), (2, BASE + "\n", "en", "b", 2), (3, BASE.replace("moon", "sun"), "en", None, 3),
        (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \t\n", None, "a", 0), (7, "!!! 123 ???", "en", "a", 0), (8, long, "en", "a", len(long)),
        (9, f"before it {ITEM} and after it", "en", "b", 1), (9, f"before it {ITEM} and after it", "en", "b", 1), (None, "no id here at all", "en", "b", 1), (None, "no id here at all", "en", "b", 1),
        (10, "Ünïcode 日本語 текст\nline two\nline two\n", "de", "c", 1), (11, "a", "fr", "c", 1), (-12, BASE.upper(), "en", "a", 1),
        *[(20 + k, f"shared line\n  SHARED Line \nown line {k}\n\n", "en", "hot", 1) for k in range(12)],
    ]
    return rows


def frame(spark, rows=None, clash=True):
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASHES})
    return df.repartition(3)


def fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=3):
    """Component number of each fingerprint, by comparing all pairs."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def rng(seed=0):
    return np.random.default_rng(seed)
