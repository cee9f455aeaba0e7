"""License scans with a positional index of rare license words.

The notices' words are indexed by position. The inverse document frequency of every license word is
counted over the whole corpus, and of each notice the rarest words are posted: as many as may differ in
a match, and two more, so every match agrees with at least two postings and none is lost, however many
notices a file holds. A file is scanned in three steps:

1. its words that have postings are looked up; only notices that they name are considered, and of these
   only such of whose words the file holds enough, so a notice that shares no rare word with the file costs nothing;
2. the postings of such a notice are intersected by relative position: places in the file less places
   in the notice, of which two must be equal;
3. where they are, the notice is compared word by word. At least ``MATCH`` of its words must match, and
   a mandatory phrase must stand there. A match adds the notice's label.

Beside it the base labels come from phrases whose words stand consecutively anywhere in the text.

The notices are a parameter; the index goes to every task, and its size is that of the notices alone.

Defined results: a null text counts as empty and has no words; extra columns are ignored; repeated
rows are repeated in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, ship, text_chunks

MATCH = 0.75
#: Places of one notice that are compared at a time: with the notice's length this bounds the memory.
BLOCK = 4096
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Label, notice, mandatory phrases of which one must stand in the match. Public texts of the licences' own notices.
NOTICES = [
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses"]),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ["apache license"],
    ),
    ("mit", "released under the MIT license", ["mit license"]),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        ["permission is hereby granted free of charge"],
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ["permission is hereby granted free of charge"],
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["endorse or promote products derived from this software"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ["for any purpose with or without fee is hereby granted"],
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ["alter it and redistribute it freely"],
    ),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", ["boost software license"]),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ["free and unencumbered software"],
    ),
    ("gpl", "this work is licensed under the GNU General Public License version 3", ["general public license"]),
    (
        "gpl",
        "this program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ["general public license"],
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
        ["gnu general public license"],
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["affero general public license"]),
    ("fdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", ["free documentation license"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        ["mozilla public license"],
    ),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License", ["common development and distribution license"]),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ["sil open font license"]),
    ("cc-by", "licensed under CC BY 4.0", ["cc by 4", "cc by 3", "cc by 2"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by", "this work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution"]),
    ("cc-by-sa", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(lower_ascii(text or ""))


#: The notices as lower-case words.
TEMPLATES = [(label, b" ".join(words_of(notice)).decode(), phrases) for label, notice, phrases in NOTICES]
_BASE = [(tuple(words_of(p)), label) for p, label in BASE]
_BASE_FIRST = frozenset(p[0] for p, _ in _BASE)


def document_frequency(docs: DataFrame, known: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Rows, and for each of the known words the rows that hold it, over the whole corpus."""
    ship(docs.sparkSession)

    def run(batches):
        seen: Counter = Counter()
        rows = 0
        for pdf in batches:
            rows += len(pdf)
            for text in pdf["text"]:
                seen.update(known.intersection(words_of(text)))
        yield pd.DataFrame({"word": [w.decode() for w in seen] + [""], "n": [*seen.values(), rows]})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in found}
    return counts.pop(b"", 0), counts


def _places(words: list[bytes], wanted) -> dict[bytes, list[int]]:
    places: dict[bytes, list[int]] = {}
    for k in [k for k, w in enumerate(words) if w in wanted]:
        places.setdefault(words[k], []).append(k)
    return places


def _stands(words: list[bytes], at: int, phrase: tuple[bytes, ...]) -> bool:
    return tuple(words[at : at + len(phrase)]) == phrase


class Index:
    """Postings of each notice's rarest words: word -> (notice, position)."""

    def __init__(self, rows: int, counts: dict[bytes, int], templates: list = TEMPLATES):
        self.notices = [(label, words_of(t), [tuple(words_of(p)) for p in phrases]) for label, t, phrases in templates]
        self.distinct = [Counter(t) for _, t, _ in self.notices]
        self.idf = {w: math.log((1 + rows) / (1 + counts.get(w, 0))) for t in self.distinct for w in t}
        self.codes = {w: k for k, w in enumerate(self.idf)}
        self.coded = [np.array([self.codes[w] for w in t], np.int32) for _, t, _ in self.notices]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t, _) in enumerate(self.notices):
            rarest = sorted(range(len(t)), key=lambda p: (-self.idf[t[p]], t[p], p))
            for p in rarest[: math.floor((1 - MATCH) * len(t)) + 2]:
                self.postings[t[p]].append((k, p))

    def candidates(self, held: set[bytes]) -> dict[int, list[tuple[bytes, int]]]:
        """Notices of which a file with these words can hold a match, with their postings among the words."""
        named = defaultdict(list)
        for w in held & self.postings.keys():
            for k, p in self.postings[w]:
                named[k].append((w, p))
        return {k: at for k, at in named.items() if len(at) > 1 and sum(n for w, n in self.distinct[k].items() if w in held) >= MATCH * len(self.notices[k][1])}

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Label -> share of the notice's words that match at its best place."""
        found: dict[str, float] = {}
        named = self.candidates(set(words))
        if not named:
            return found
        firsts = {p[0] for k in named for p in self.notices[k][2]}
        places = _places(words, {w for at in named.values() for w, _ in at} | firsts)
        pad = max(len(self.coded[k]) for k in named)
        coded = np.full(len(words) + 2 * pad, -1, np.int32)
        coded[pad : pad + len(words)] = [self.codes.get(w, -1) for w in words]
        for k, postings in named.items():
            label, notice, phrases = self.notices[k]
            starts = np.unique([at for p in phrases for at in places.get(p[0], ()) if _stands(words, at, p)]).astype(np.int64)
            offsets, votes = np.unique(np.concatenate([np.array(places[w], np.int64) - p for w, p in postings]), return_counts=True)
            offsets = offsets[votes > 1]
            for a in range(0, len(offsets), BLOCK):
                block = offsets[a : a + BLOCK]
                share = (coded[block[:, None] + (pad + np.arange(len(notice)))] == self.coded[k]).sum(1) / len(notice)
                block, share = block[share >= MATCH], share[share >= MATCH]
                phrase = np.searchsorted(starts, np.maximum(block, 0)) < np.searchsorted(starts, np.minimum(block + len(notice), len(words)))
                if phrase.any():
                    found[label] = max(found.get(label, 0.0), float(share[phrase].max()))
        return found


def scan_text(text: str | None, index: Index) -> tuple:
    words = words_of(text)
    places = _places(words, _BASE_FIRST)
    base = sorted((k, label) for phrase, label in _BASE for k in places.get(phrase[0], ()) if _stands(words, k, phrase))
    named = {label for _, label in base}
    added = index.matches(words)
    score = max([1.0 * bool(base), *added.values()])
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(named)), ",".join(sorted(named | set(added))), score


def scan(docs: DataFrame, templates: list = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    spark = docs.sparkSession
    known = frozenset(w for _, t, _ in templates for w in words_of(t))
    index = spark.sparkContext.broadcast(Index(*document_frequency(docs, known), templates))

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in text_chunks(texts):
                out = pd.DataFrame([scan_text(t, index.value) for t in texts[a:b]], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
                out = out.astype({"first_word": "Int64", "last_word": "Int64"})
                out.insert(0, "doc_id", pdf["doc_id"].iloc[a:b].to_numpy())
                yield out

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInPandas(run, kind).withColumn("doc_id", F.col("doc_id").cast("long"))
