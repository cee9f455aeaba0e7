"""The pipeline against the same five steps in plain Python, and every registered query on small tables."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from arborlake.llm import packing, queries

from .helpers import BASE, ITEM, awkward, frame
from .test_text import plain_overlaps

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")
DATA = "/root/testdata/sf0.001"


def shingles(text):
    """Sets of five words in a row, A-Z lower-cased; fewer words are one shingle."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def plain_pipeline(rows, items):
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)):
        best.setdefault(r[1].translate(BLANK), r)
    rows = list(best.values())
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        first.setdefault(label[k], k)
    rows = [rows[k] for k in sorted(first.values())]
    rows = [r for r in rows if not plain_overlaps([r], items)]
    encode = packing.encoder(*packing.vocabulary()).encode_ordinary
    return Counter((r[0], k, s, n) for r in rows for k, (s, n) in enumerate(packing.cut(len(encode(r[1])) + 1)))


def test_against_plain_steps(spark, tmp_path):
    """With near copies that three-word fingerprints part, a long text, and a template that many texts share."""
    items = [(1, ITEM), (2, "four words of benchmark")]
    words = BASE.split() * 2
    more = [(300 + k, " ".join([*words[:-1], f"end{k}"]), "en", "n", 1) for k in range(5)] + [(400 + k, " ".join([*words, *[f"own{k}x{j}" for j in range(40)]]), "en", "hot", 1) for k in range(40)]
    more += [(500, " ".join(f"long{k % 3001}" for k in range(30_000)), "en", "l", 1), (501, f"so {items[1][1]} ends", "en", "l", 1)]
    rows = [*awkward(), *more]
    frame(spark, rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == plain_pipeline(rows, items)


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_runs(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.count() > 0 and {"doc_id", "conv_id", "query_id"} & {*df.columns}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    want = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(want.select(*cols).fetchall())
