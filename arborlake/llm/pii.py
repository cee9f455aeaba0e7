"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what fixed patterns find (e-mail and IP addresses, card and phone numbers). The two words
left of an identifier are its lexical pattern. Patterns and the identifiers that they stand before make
a graph: a pattern's score is the share of its identifiers that are believed, with two doubts added;
an identifier's is one minus the product of its patterns' doubts, and a seed's is 1. Spark computes
both in turn for ``ROUNDS`` rounds. Patterns with a score of ``CONFIDENT`` or more and ``SUPPORT``
different believed identifiers then find the unseen identifiers behind them: words with at least four
digits that no seed covers.

Texts are read once. Places come from splitting a text at a pattern: the lengths of the gaps and
matches before it add up to a match's place. Matches are added up in runs of ``RUN``, so that a text full
of identifiers does not take the square of their number. The patterns use possessive repeats and start only where
a run of their characters starts or the last match ended, which finds the same leftmost matches in
linear time without deep recursion. What is found is written to the shared folder; the graph works on
that alone. Every grouping combines before its shuffle.

Defined results: a null text counts as empty and has no spans; an identifier that two kinds of seed
cover is a span of each; extra columns are ignored; repeated rows are repeated in the result; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ["email", "ip", "card", "phone"]
ROUNDS, CONFIDENT, SUPPORT = 3, 0.6, 3
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OTHER = r"(?:\G|(?<![A-Za-z0-9._@/-]))[A-Za-z._@/-]*+[0-9][A-Za-z0-9._@/-]*+"
_LEFT = r"(\p{L}+)[^\p{L}\p{N}]+(\p{L}+)[^\p{L}\p{N}]*$"
_SPAN = "array<struct<s:int,e:int,v:string,before:string>>"
_HEAD = "array<struct<at:int,before:string>>"
LEFT_CHARS, RUN = 48, 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(items: Column) -> Column:
    """An array that is not empty, as arrays of ``RUN`` elements, the last perhaps shorter."""
    last = F.floor((F.size(items) - 1) / F.lit(RUN)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * RUN + 1, F.lit(RUN)))


def _last(text: Column) -> Column:
    return F.right(text, F.lit(LEFT_CHARS))


def places(text: Column, pattern: str) -> Column:
    """Start, end and value of the leftmost matches that do not overlap, in code points, and what stands before them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("v")))

    def past(acc, run):
        return F.struct((acc["at"] + F.length(run)).alias("at"), _last(F.concat(acc["before"], run)).alias("before"), F.concat(acc["heads"], F.array(F.struct(acc["at"].alias("at"), acc["before"].alias("before")))).alias("heads"))

    def add(acc, x):
        before = _last(F.concat(acc["before"], x["gap"]))
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["v"])
        span = F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"), before.alias("before"))
        return F.struct(e.alias("at"), _last(F.concat(before, x["v"])).alias("before"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def fold(run, head):
        start = F.struct(head["at"].alias("at"), head["before"].alias("before"), F.array().cast(_SPAN).alias("spans"))
        return F.aggregate(run, start, add, lambda acc: acc["spans"])

    def spans(runs):
        texts = F.transform(runs, lambda r: F.array_join(F.transform(r, lambda x: F.concat(x["gap"], x["v"])), ""))
        nothing = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), F.array().cast(_HEAD).alias("heads"))
        return F.flatten(F.zip_with(runs, F.aggregate(texts, nothing, past, lambda acc: acc["heads"]), fold))

    return F.when(F.size(found) > 0, _let(_let(steps, _runs), spans)).otherwise(F.array().cast(_SPAN))


def _free(others: Column, seeds: Column) -> Column:
    """The others, which are in order, that no seed overlaps; each run of them is held against the seeds in its range only."""
    overlap = lambda y, s, e: (y["s"] < e) & (s < y["e"])

    def of_run(run):
        near = F.filter(seeds, lambda y: overlap(y, F.get(run, F.lit(0))["s"], F.element_at(run, -1)["e"]))
        return _let(near, lambda near: F.filter(run, lambda x: ~F.exists(near, lambda y: overlap(y, x["s"], x["e"]))))

    return F.when(F.size(others) > 0, F.flatten(F.transform(_runs(others), of_run))).otherwise(others)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def worth(k):
        d = F.substr(digits, k, F.lit(1)).cast("int") * (1 + F.pmod(k + 1, F.lit(2)))
        return F.when(d > 9, d - 9).otherwise(d)

    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, k: acc + worth(k))
    return F.when(n.between(13, 19), F.pmod(total, F.lit(10)) == 0).otherwise(False)


def _small_parts(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, r"\.", -1), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False))


def _phone_length(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def _left_words(before: Column) -> Column:
    """The last two words, lower-cased, or null."""
    one, two = F.regexp_extract(F.lower(before), _LEFT, 1), F.regexp_extract(F.lower(before), _LEFT, 2)
    return F.when(F.length(two) > 0, F.concat_ws(" ", one, two))


def seeds_and_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, row, seeds (kind, s, e, v, left) and others (s, e, v, left) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast(_SPAN)
    rows = rows.select("*", F.col("text").rlike("[0-9]").alias("digit"))
    rows = rows.select(
        "doc_id",
        F.when(F.contains("text", F.lit("@")), places(F.col("text"), _EMAIL)).otherwise(none).alias("email"),
        F.when(F.col("digit"), places(F.col("text"), _IP)).otherwise(none).alias("ip"),
        F.when(F.col("digit"), places(F.col("text"), _CARD)).otherwise(none).alias("card"),
        F.when(F.contains("text", F.lit("+")), places(F.col("text"), _PHONE)).otherwise(none).alias("phone"),
        F.when(F.col("digit"), places(F.col("text"), _OTHER)).otherwise(none).alias("others"),
    )
    good = {"ip": _small_parts, "card": _luhn, "phone": _phone_length}

    def passing(kind: str) -> Column:
        return F.filter(kind, lambda x: good[kind](x["v"])) if kind in good else F.col(kind)

    rows = rows.select("doc_id", "others", *[passing(k).alias(k) for k in KINDS])

    def seen(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v"), _left_words(x["before"]).alias("left")))

    rows = rows.select("doc_id", "others", F.concat(*[seen(k) for k in KINDS]).alias("seeds"))
    trimmed = F.transform("others", lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(F.regexp_replace(x["v"], "[._@/-]+$", ""))).alias("e"), F.regexp_replace(x["v"], "[._@/-]+$", "").alias("v"), x["before"].alias("before")))
    free = _let(F.filter(trimmed, lambda x: F.length(_digits(x["v"])) >= 4), lambda wanted: _free(wanted, F.col("seeds")))
    others = F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v"), _left_words(x["before"]).alias("left")))
    return rows.select("doc_id", "seeds", others.alias("others"), F.monotonically_increasing_id().alias("row"))


def score_patterns(found: DataFrame) -> DataFrame:
    """left, kind, score and support of the patterns, after ``ROUNDS`` rounds over the graph."""
    seeds = found.select(F.explode("seeds").alias("x")).select("x.left", "x.kind", "x.v").where("left is not null").distinct()
    others = found.select(F.explode("others").alias("x")).select("x.left", "x.v").where("left is not null").distinct()
    edges = seeds.select("left", "v").unionByName(others).distinct()
    edges = materialise(edges, "pii-edges")
    of_pattern = edges.groupBy("left").agg(F.count(F.lit(1)).alias("n"))
    sure = seeds.select("kind", "v", F.lit(1.0).alias("belief")).distinct()
    believed = sure = materialise(sure, "pii-seeds")
    for k in range(ROUNDS):
        met = edges.join(believed, "v").groupBy("left", "kind").agg(F.sum("belief").alias("belief"), F.count_if(F.col("belief") >= 0.5).alias("support"))
        patterns = materialise(met.join(of_pattern, "left").select("left", "kind", (F.col("belief") / (F.col("n") + 2)).alias("score"), "support"), "pii-patterns")
        if k + 1 < ROUNDS:
            strong = patterns.where(F.col("support") >= SUPPORT)
            doubt = edges.join(strong, "left").groupBy("kind", "v").agg(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))).alias("doubt"))
            fresh = doubt.join(sure, ["kind", "v"], "left_anti").select("kind", "v", (1 - F.exp("doubt")).alias("belief"))
            believed = sure.unionByName(fresh)
    return patterns


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and added (arrays of kind, s, e) of every row."""
    found = materialise(seeds_and_candidates(docs), "pii-found")
    patterns = score_patterns(found).where((F.col("score") >= CONFIDENT) & (F.col("support") >= SUPPORT))
    best = patterns.groupBy("left").agg(F.max(F.struct("score", F.negative("kind").alias("first"))).alias("b")).select("left", F.negative("b.first").alias("kind"))
    behind = found.select("row", F.explode("others").alias("x")).select("row", "x.left", "x.s", "x.e")
    added = behind.join(best, "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "s", "e"))).alias("added"))
    out = found.join(added, "row", "left")
    base = F.sort_array(F.transform("seeds", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    count = lambda k: F.size(F.filter("seeds", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], base.alias("base"), F.coalesce("added", F.array().cast("array<struct<kind:int,s:int,e:int>>")).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
