"""Language ID, language model, licenses, personal data and decontamination against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import decontamination, langid, language_model, licenses, pii, queries

from .helpers import BASE, ITEM, awkward, frame


# language ID


def plain_viterbi(scores, penalty):
    best = [([k], s) for k, s in enumerate(scores[0])]
    for row in scores[1:]:
        new = []
        for k, s in enumerate(row):
            path, v = max(((p, x - (penalty if p[-1] != k else 0)) for p, x in best), key=lambda t: t[1])
            new.append((path + [k], v + s))
        best = new
    return max(best, key=lambda t: t[1])


def test_viterbi():
    rng = np.random.default_rng(0)
    sizes = np.array([5, 0, 1, 9, 3])
    scores = rng.normal(0, 6, (int(sizes.sum()), 3)).astype(np.float32)
    got, at = langid.viterbi(scores, sizes, 4.0), 0
    for n in sizes:
        if n:
            assert got[at : at + n].tolist() == plain_viterbi(scores[at : at + n].tolist(), 4.0)[0]
        at += n


def test_staying_is_certain():
    """Texts that are settled without Viterbi get the labels that it gives."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 12, 300)
    scores = rng.normal(0, 2, (int(sizes.sum()), 3)).astype(np.float32)
    for penalty in (1.0, 4.0, 8.0):
        assert (langid.label_words(scores, sizes, penalty) == langid.viterbi(scores, sizes, penalty)).all()


WORDS = {"aa": ["kala", "muna", "talo", "sina", "puuro"], "bb": ["grund", "wirth", "schnell", "krampf"], "ru": ["слово", "время", "город"]}


def sample(lang, n, rnd):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def test_language_spans_and_held_out_accuracy(spark):
    rnd = random.Random(0)
    rows = [(i, sample(lang, 30, rnd), lang, "s", 1) for i, lang in enumerate(["aa", "bb", "ru"] * 40)]
    mixed = sample("aa", 20, rnd) + " " + sample("bb", 30, rnd)
    rows += [(1000, mixed, None, "s", 1), (1001, None, "aa", "s", 1), (1002, "12 ! ½ ² _", None, "s", 1), (1003, "Ωμέγα", None, "s", 1)]
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, rows)).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] and got[i]["score"] == 1 for i in range(120))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert [(s["lang"], s["first_word"], s["n_words"]) for s in got[1000]["spans"]] == [("aa", 0, 20), ("bb", 20, 30)]
    assert got[1000]["lang_pred"] == "bb" and 0.5 < got[1000]["score"] < 1
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1001, 1002)] == [("und", 0.0)] * 2
    assert got[1003]["lang_pred"] in WORDS


def test_language_is_not_read_from_labels(spark):
    rnd = random.Random(1)
    rows = [(i, sample("aa" if i % 2 else "bb", 25, rnd), "aa" if i % 2 else "bb", "s", 1) for i in range(60)]
    held = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s, n) for i, t, lang, s, n in rows]
    a, b = ({r["doc_id"]: r["lang_pred"] for r in langid.identify(frame(spark, x)).collect()} for x in (rows, held))
    assert a == b


def test_language_of_awkward_and_empty(spark):
    assert langid.identify(frame(spark)).count() == len(awkward())
    assert langid.identify(frame(spark, [])).count() == 0
    unlabelled = frame(spark, [(1, "words here", None, None, 1)])
    assert langid.identify(unlabelled).first()["lang_pred"] == "und"
    kept = langid.keep_identified(frame(spark))
    letters = [r for r in awkward() if re.search(r"[^\W\d_]", r[1] or "")]
    assert kept.count() == len(letters) and kept.columns == frame(spark).columns


# language model


def test_model_is_normalised():
    """Over all outputs; inside a class over its words and the unknown one."""
    rng = np.random.default_rng(0)
    m = language_model.Model(rng.normal(0, 0.5, language_model.Model.SIZE))
    one, two = m.tables()
    a, b = 3, 77
    q = m.inner[a] @ m.first + m.inner[b] @ m.second
    assert np.allclose(one[a] + two[b], m.outer @ np.append(q, 1), atol=1e-3)


def test_log_sums(spark):
    rng = np.random.default_rng(0)
    tables = language_model.Model(rng.normal(0, 0.5, language_model.Model.SIZE)).tables()
    z = language_model.log_sums(spark, tables)
    for a, b in [(0, 0), (5, 900), (1690, 3)]:
        assert z[a, b] == pytest.approx(np.log(np.exp((tables[0][a] + tables[1][b]).astype(float)).sum()), abs=1e-3)


def test_scores(spark):
    """The base against plain counts; the model learns an order that single words do not show."""
    rnd = random.Random(0)
    pairs = {f"a{k}": f"b{k}" for k in range(30)}
    text = lambda: " ".join(f"{a} {pairs[a]}" for a in rnd.choices(list(pairs), k=40))
    rows = [(i, text() + (f" rare{i}" if i % 5 == 0 else ""), "en", "s", 1) for i in range(400)] + [(9001, None, None, None, None), (9002, "a1\tB1 \n zzz", None, None, None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    toks = {i: (t or "").lower().split() for i, t, *_ in rows}
    count = Counter(w for i, ws in toks.items() if not held(i) for w in ws)
    ends = sum(not held(i) for i in toks)
    n, v = sum(count.values()) + ends, len(count) + 1
    got = {r["doc_id"]: r for r in language_model.score(frame(spark, rows)).collect()}
    assert set(got) == set(toks)
    for i, ws in toks.items():
        r = got[i]
        want = sum(math.log10((c + 1) / (n + v + 1)) for c in [*(count[w] for w in ws), ends])
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["train_tokens"] == n and r["held_out"] == held(i)
        assert (r["n_tokens"], r["n_known"]) == (len(ws) + 1, sum(count[w] > 0 for w in ws) + 1)
        assert r["score"] < 0
    test = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_scores_of_awkward_and_empty(spark):
    assert language_model.score(frame(spark)).count() == len(awkward())
    assert language_model.score(frame(spark, [])).count() == 0


def test_cutoff_takes_whole_counts(spark):
    counts = spark.createDataFrame([(bytes([65 + k]), n) for k, n in enumerate([9, 5, 5, 5, 2, 1])], "word binary, n long")
    assert [language_model._cutoff(counts, k) for k in (1, 2, 4, 5, 6, 99)] == [6, 6, 3, 2, 1, 1]


# licenses


def test_licenses(spark):
    rows = [
        (0, "x Licensed under the Apache License, Version 2.0. y", "en", "s", 1), (1, "CC BY and cc-by, ccby", "en", "s", 1), (2, "The General\nPublic  License... All Rights Reserved", "en", "s", 1),
        (3, None, None, None, None), (4, "released under the mit licence", "en", "s", 1), (5, "the license of this is under a version", "en", "s", 1),
        (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and associated documentation files (the Program), to deal in the Program without restriction", "en", "s", 1),
        *[(10 + k, BASE, "en", "s", 1) for k in range(20)],
    ]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[0]["labels"] == "apache-2.0" and got[0]["base_labels"] == "" and got[0]["first_word"] is None and got[0]["score"] == 1
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (6, 2, 0, 3, "cc-by")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (2, 1, 4, "gpl,reserved")
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["labels"], got[3]["score"]) == (0, 0, "", 0)
    assert got[4]["labels"] == "" and got[5]["labels"] == "" and got[6]["labels"] == "mit" and 0.75 <= got[6]["score"] <= 1
    assert got[10]["labels"] == ""
    assert licenses.scan(frame(spark)).count() == len(awkward()) and licenses.scan(frame(spark, [])).count() == 0


def plain_labels(text):
    """Every template at every place."""
    words = licenses.words_of(text)
    out = {}
    for label, t, phrases in licenses.TEMPLATES:
        t = t.encode().split()
        for o in range(-len(t) + 1, len(words)):
            span = range(max(o, 0), min(o + len(t), len(words)))
            share = sum(words[k] == t[k - o] for k in span) / len(t)
            if share >= licenses.MATCH and any(words[k : k + len(p.split())] == p.encode().split() for p in phrases for k in span):
                out[label] = max(out.get(label, 0), share)
    return out


def test_licenses_of_files_with_several_notices(spark):
    rnd = random.Random(4)
    texts = [t for _, t, _ in licenses.TEMPLATES]
    rare = "apache mozilla redistribution obtaining http www"
    rows = [(0, " x ".join(texts), "en", "s", 1), (1, f"{texts[3]} licensed under cc by nc 4 0", "en", "s", 1), (2, f"{rare} y {texts[2]}", "en", "s", 1)]
    for i in range(3, 150):
        words = " ".join(rnd.choices(texts, k=rnd.randint(1, 4))).split()
        rows.append((i, " ".join(rnd.choice([*licenses.TEMPLATES[1][1].split(), "z"]) if rnd.random() < 0.12 else w for w in words), "en", "s", 1))
    for r in licenses.scan(frame(spark, rows)).collect():
        want = plain_labels(rows[r["doc_id"]][1])
        base = set(filter(None, r["base_labels"].split(",")))
        assert r["labels"] == ",".join(sorted(base | set(want))) and r["score"] == max([float(bool(base)), *want.values()])
        assert r["doc_id"] or set(want) == {label for label, _, _ in licenses.TEMPLATES}


def test_licenses_looks_at_named_notices_only(spark):
    """Notices that share no rare word with the file are never looked at; the result stays."""
    many = [*licenses.TEMPLATES, *[(f"made-{k}", " ".join(f"w{k}x{j}" for j in range(40)), [f"w{k}x3 w{k}x4"]) for k in range(500)]]
    text = f"{BASE} {licenses.TEMPLATES[4][1]} {BASE} " + " ".join(f"w7x{j}" for j in range(2, 40))
    few, all_of_them = licenses.Index(10, {}), licenses.Index(10, {}, many)
    words = licenses.words_of(text)
    assert set(all_of_them.candidates(set(words))) == {*few.candidates(set(words)), len(licenses.TEMPLATES) + 7}
    rows = frame(spark, [(1, text, "en", "s", 1), (2, "w9x1 w9x2", "en", "s", 1)])
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(rows, many).collect()} == {1: "made-7,mit", 2: ""}


def test_licenses_of_long_and_repetitive_texts():
    index = licenses.Index(100, dict.fromkeys(licenses.words_of(" ".join(t for _, t, _ in licenses.TEMPLATES)), 50))
    for text, want in (("license " * 200_000, {}), ("general public license " * 60_000, {}), ("the software is provided as is " * 40_000, {}), ("x " * 100_000 + licenses.TEMPLATES[5][1], {"mit": 1.0})):
        assert index.matches(licenses.words_of(text)) == want


# personal data

BASE_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE_PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def test_base_spans(spark):
    rnd = random.Random(0)
    bits = ["a", "Z9", "@", ".", "..", "-", "+", " ", "_", "%", "1", "42", "255.", "256.", "0", "4111111111111111", "(", ")", "é", "😀", "\n", "x@y.z", "1.2.3.4", "+1 (234) 555-6789", "4111 1111 1111 1111", "007.1.2.3"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(1, 30))) for _ in range(400)] + ["1 " * 20_000, "7" * 20_000, "a." * 10_000 + "@b", "+" + "1-" * 9_000, "a@b.c_x@d.e", None, ""]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    for r in pii.find_personal_data(frame(spark, rows)).select("doc_id", *[f"n_{k}" for k in pii.KINDS], pii.written(F.col("base")).alias("base")).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base"] == ",".join(want), repr(texts[r["doc_id"]])[:200]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]


def test_texts_full_of_identifiers(spark):
    """Linear in their number: 50,000 in a text, and several runs of them against the plain rules, contexts included."""
    text = "".join(f"see the no {k:05d}-x, {k % 256}.1.2.3 or +1 234 555 {k % 9973:04d}\n" for k in range(700))
    many = "".join(f"id {k:06d} " for k in range(50_000))
    got = {r["doc_id"]: r for r in pii.seeds_and_candidates(frame(spark, [(0, text, None, None, None), (1, many, None, None, None)])).collect()}
    spans = [f"{pii.KINDS[x['kind']]}:{x['s']}:{x['e']}" for x in got[0]["seeds"]]
    assert spans == plain_spans(text) and len(got[1]["others"]) == 50_000 and got[1]["others"][-1]["e"] == len(many) - 1
    taken = [tuple(map(int, s.split(":")[1:])) for s in spans]
    want = []
    for m in re.finditer(r"[A-Za-z._@/-]*[0-9][A-Za-z0-9._@/-]*", text):
        v = m.group().rstrip("._@/-")
        s, e = m.start(), m.start() + len(v)
        if sum(c.isdigit() for c in v) >= 4 and not any(a < e and s < b for a, b in taken):
            left = re.search(r"([^\W\d_]+)[^\w]+([^\W\d_]+)[^\w]*$", text[max(s - 48, 0) : s].lower())
            want.append((s, e, v.lower(), left and " ".join(left.groups())))
    assert len(want) == 700 and [(x["s"], x["e"], x["v"], x["left"]) for x in got[0]["others"]] == want


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"some text. call me on +1 (234) 555-{1000 + i} today", None, None, None) for i in range(12)]
    rows += [(100, "please call me on 555-0199-ext4 soon", None, None, None), (101, "the year was 20240101 then", None, None, None)]
    got = {r["doc_id"]: [tuple(x) for x in r["added"]] for r in pii.find_personal_data(frame(spark, rows)).collect()}
    at = rows[12][1].index("555-0199-ext4")
    assert got[100] == [(3, at, at + len("555-0199-ext4"))] and not any(v for k, v in got.items() if k != 100)


def test_personal_data_of_awkward_and_empty(spark):
    assert pii.find_personal_data(frame(spark)).count() == len(awkward())
    assert pii.find_personal_data(frame(spark, [])).count() == 0
    assert hashlib.sha256(b"").hexdigest() and "op9_pii" in queries.queries()


# decontamination


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").repartition(2)


def laid(w, b, shift):
    """Some window, or the whole, of b agrees with w at this shift in 0.8 of its words."""
    same = [0 <= shift + k < len(w) and w[shift + k] == x for k, x in enumerate(b)]
    windows = [same, *[same[max(0, q - 8) : q + 16] for q in range(len(b) - 7)]]
    return any(sum(x) / len(x) >= 0.8 for x in windows)


def plain_overlaps(docs, items):
    toks = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = set()
    for d in docs:
        w = toks(d[1])
        for i, t in items:
            b = toks(t)
            if 0 < len(b) < 8 and any(w[p : p + len(b)] == b for p in range(len(w))):
                out.add((d[0], i))
            at = {p - q for m in decontamination.MASKS for p in range(len(w) - m[-1]) for q in range(len(b) - m[-1]) if len(b) >= 8 and all(w[p + o] == b[q + o] for o in m)}
            if any(laid(w, b, shift) for shift in at):
                out.add((d[0], i))
    return out


def test_overlaps(spark):
    words = ITEM.split()
    swapped = " ".join("other" if k % 8 == 4 else w for k, w in enumerate(words))
    half = " ".join(words[:10]) + " then it goes on in quite another way for the rest of the text"
    short = "one two three four"
    docs = [*awkward(), (50, f"so {swapped} indeed", "en", "s", 1), (51, half, "en", "s", 1), (52, short, "en", "s", 1), (53, ITEM.upper().replace(" ", ", "), "en", "s", 1)]
    items = [(1, ITEM), (2, short), (3, None), (4, ""), (5, BASE)]
    for part in (decontamination.PART_WORDS, 20):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_overlaps(frame(spark, docs), bench(spark, items), part_words=part).collect()}
        assert got == plain_overlaps(docs, items)
    assert {(9, 1), (50, 1), (53, 1), (0, 5), (52, 2)} <= got and (51, 1) not in got and sum(i == 2 for _, i in got) == 1


@pytest.mark.parametrize("n", [8, 9, 10, 12, 16, 20, 30, 60])
@pytest.mark.parametrize("share", [0.1, 0.2])
def test_no_substituted_item_is_lost(n, share):
    """Whatever tenth or fifth of the words is substituted: against a comparison without masks, at every length."""
    import itertools

    rnd, words = random.Random(n), [f"w{k}" for k in range(n)]
    k = int(n * share)
    ways = list(itertools.combinations(range(n), k))[::7] if n <= 12 else [rnd.sample(range(n), k) for _ in range(150)] + [range(a, a + k) for a in range(n - k)]
    for gone in ways:
        other = ["x" if i in gone else w for i, w in enumerate(words)]
        assert laid(["a", "b", *other, "c"], words, 2)
        assert plain_overlaps([(1, "a b " + " ".join(other) + " c d")], [(1, " ".join(words))]), list(gone)


def test_recall_in_documents(spark):
    """The same on Spark, a hundred documents of every length and share."""
    rnd, docs, items = random.Random(3), [], []
    for k in range(100):
        n = rnd.choice([8, 10, 12, 16, 20, 30])
        words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        gone = rnd.sample(range(n), int(n * rnd.choice([0.1, 0.2])))
        items.append((k, " ".join(words)))
        docs.append((k, "so " + " ".join("x" if i in gone else w for i, w in enumerate(words)) + " then", "en", "s", 1))
    found = decontamination.find_overlaps(frame(spark, docs), bench(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k) for k in range(100)} and all(r["share"] >= 0.8 for r in found)


def test_long_texts_beside_short_and_repeated_items(spark):
    """A text of 200,000 words and one of one repeated word, an item of four words and one of a word repeated forty times."""
    rnd = random.Random(5)
    long = " ".join(f"v{rnd.randrange(5000)}" for _ in range(200_000))
    docs = [(1, f"{long} one two three four", "en", "s", 1), (2, "ha " * 50_000, "en", "s", 1), (3, "one two three", "en", "s", 1)]
    items = [(1, "one two three four"), (2, " ".join(["ha"] * 40)), (3, ITEM)]
    found = decontamination.find_overlaps(frame(spark, docs), bench(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 2)}


def test_contaminated_documents_go(spark):
    docs = frame(spark)
    kept = decontamination.drop_contaminated(docs, bench(spark, [(1, ITEM)]))
    assert kept.count() == len(awkward()) - 2 and kept.columns == docs.columns
    assert decontamination.drop_contaminated(frame(spark, []), bench(spark, [(1, ITEM)])).count() == 0
    assert decontamination.drop_contaminated(docs, bench(spark, [(1, ITEM)]).limit(0)).count() == len(awkward())


def test_items_without_an_id(spark):
    found = decontamination.find_overlaps(frame(spark, clash=False), bench(spark, [(None, ITEM), (1, "an item of eight words that is clean")])).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(9, None)}
