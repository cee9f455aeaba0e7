"""Benchmark decontamination by spaced seeds.

Words are hashed. Fixed masks look at four words out of up to eight and ignore the others, so that a seed survives
substituted words there. The three masks are chosen so that every eight words in a row, of which any two are substituted, still
hold a seed; and whichever fifth of an item's words is substituted, some eight words in a row have at most two of them. So no
item of ``SPAN`` words or more that agrees in ``SIMILARITY`` of its words is passed over by the seeds.

Seeds of the benchmark and of the documents are joined and leave the distinct places where an item is to be laid over a
document (row, item, shift). There the words are compared one by one: the whole item, and windows of it, eight words and
up to ``AROUND`` words on either side. A place holds if at least ``SIMILARITY`` of a window's or of the item's words agree, so
substituted words count against it and no more. Items of fewer than ``SPAN`` words are found where they stand whole and unchanged, by
the hash of all their words, in a pass of their own.

All of it is DataFrame functions. Word hashes are one array per document; its positions are exploded, hashed
and joined in one generated stage that carries no array further: what leaves it is one small row per distinct place. Texts come back
and are hashed again for rows with a place only. The benchmark side is broadcast in parts of at most ``PART_WORDS`` words (checked by a
count); a larger benchmark takes more passes, not a larger broadcast.

Defined results: null texts hold no words and are clean; items without a word are never
found; items with a null ``item_id`` are found like others; rows that share a ``doc_id`` are reported as one document, each laid under the items by itself; a null ``doc_id`` is
a value like any other; ``drop_contaminated`` judges each row by itself, whatever its id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .simhash import numbered

SPAN = 8
#: The positions that each mask looks at. Split eight words into four pairs: two pairs that are whole are one of these, somewhere.
MASKS = [(0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7)]
AROUND = 8
SIMILARITY = 0.8
PART_WORDS = 400_000
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, words: str, keep: list[str]) -> DataFrame:
    """``keep``, at and seed: the masks' hashes at each position, each mask in a space of its own."""
    places = df.where(F.size(words) >= 4).select(*keep, words, F.explode(F.sequence(F.lit(0), F.size(words) - 4)).alias("at"))
    one = lambda k, mask: F.when(F.col("at") + mask[-1] < F.size(words), F.xxhash64(F.lit(k), *[F.get(words, F.col("at") + o) for o in mask]))
    return places.select(*keep, "at", F.explode(F.array(*[one(k, mask) for k, mask in enumerate(MASKS)])).alias("seed"))


def _runs(df: DataFrame, words: str, keep: list[str], lengths: list[int]) -> DataFrame:
    """``keep``, at and seed: the hashes of the n words from each position, for each of the lengths."""
    places = df.where(F.size(words) > 0).select(*keep, words, F.explode(F.sequence(F.lit(0), F.size(words) - 1)).alias("at"))
    one = lambda n: F.when(F.col("at") + n <= F.size(words), F.xxhash64(F.lit(n), *[F.get(words, F.col("at") + o) for o in range(n)]))
    return places.select(*keep, "at", F.explode(F.array(*[one(n) for n in lengths])).alias("seed"))


def _places(places: DataFrame, seeds: DataFrame) -> DataFrame:
    """row, key, shift: where seeds meet, each once."""
    hits = places.join(F.broadcast(seeds), "seed")
    return hits.select("row", "key", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def find_overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, item_id, n_hits (places), n_matched, share: the best window of each item found in a document."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = _overlaps(materialise(texts, "numbered-texts"), benchmark, similarity, part_words)
    return hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max("best.n_matched").cast("long").alias("n_matched"), F.max("best.share").alias("share"))


def _overlaps(texts: DataFrame, benchmark: DataFrame, similarity: float, part_words: int = PART_WORDS) -> DataFrame:
    """row, doc_id, item_id, best (share, n_matched) of every place that holds. ``texts``: row, doc_id, text, written, so that rows keep their numbers."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("item")).distinct()
    items = items.withColumn("key", F.xxhash64("item_id", "item"))  # of null ids as well; a clash is only one more place to check
    total, longest = items.agg(F.sum(F.size("item")), F.max(F.size("item"))).first()
    parts = max(1, -(-(total or 0) // part_words))
    hashed = texts.select("row", word_hashes(F.col("text")).alias("words"))
    short = sorted(r[0] for r in items.where(F.size("item").between(1, SPAN - 1)).select(F.size("item")).distinct().collect())  # at most SPAN - 1 lengths

    def against(part: DataFrame) -> DataFrame:
        seeds = _seeds(part.where(F.size("item") >= SPAN), "item", ["key"]).where("seed is not null").withColumnRenamed("at", "item_at").distinct()
        places = _places(_seeds(hashed, "words", ["row"]), seeds)
        if short:
            few = part.where(F.size("item").between(1, SPAN - 1))
            own = reduce(lambda w, n: w.when(F.size("item") == n, F.xxhash64(F.lit(n), *[F.get("item", F.lit(o)) for o in range(n)])), short, F.when(F.lit(False), F.lit(None).cast("long")))
            whole = few.select("key", F.lit(0).alias("item_at"), own.alias("seed"))
            places = places.unionByName(_places(_runs(hashed, "words", ["row"], short), whole))
        # few rows have a place as a rule, and Spark sees how many; where many have, both sides are dealt by row, which is unique among texts
        places = materialise(places, "places")
        some = texts.join(places.select("row").distinct(), "row", "left_semi").select("row", "doc_id", word_hashes(F.col("text")).alias("words"))
        met = places.join(some, "row").select("row", "doc_id", "key", "shift", F.slice("words", F.greatest("shift", F.lit(0)) + 1, F.lit(longest or 1)).alias("near"))
        laid = met.join(F.broadcast(part), "key")
        n, lead = F.size("item"), F.greatest(-F.col("shift"), F.lit(0))
        agree = F.transform("item", lambda w, k: (F.get("near", k - lead) == w).eqNullSafe(F.lit(True)).cast("int"))
        laid = laid.select("row", "doc_id", "item_id", n.alias("n"), agree.alias("agree"))
        first = lambda q: F.greatest(q - AROUND, F.lit(0))
        size = lambda q: F.least(q + SPAN + AROUND, F.col("n")) - first(q)
        added = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
        window = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - SPAN, F.lit(0))), lambda q: F.struct((added(F.slice("agree", first(q) + 1, size(q))) / size(q)).alias("share"), added(F.slice("agree", first(q) + 1, size(q))).alias("n_matched")))
        every = F.struct((added(F.col("agree")) / F.col("n")).alias("share"), added(F.col("agree")).alias("n_matched"))
        least = F.when(F.col("n") < SPAN, 1.0).otherwise(F.lit(float(similarity)))
        best = F.when(F.col("n") < SPAN, every).otherwise(F.array_max(F.concat(window, F.array(every))))
        return laid.select("row", "doc_id", "item_id", best.alias("best"), least.alias("least")).where("best.share >= least").drop("least")

    found = [against(items if parts == 1 else items.where(F.pmod(F.col("key"), F.lit(parts)) == p)) for p in range(parts)]
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, that hold no passage of the benchmark."""
    rows = numbered(docs)
    found = _overlaps(rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text")), benchmark, similarity)
    kept = rows.join(materialise(found.select("row").distinct(), "contaminated"), "row", "left_anti")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
