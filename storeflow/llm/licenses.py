"""License scans: a positional rare-token index over licence notices.

Base labels come from places where a phrase's words stand one after another. The method adds labels of its own:

1. The words of all templates form a small vocabulary; one pass over all documents counts in how many each occurs.
2. Of each template, the places with the highest IDF are looked up, whatever else a file holds: `rare` of them, and as
   many more as it takes for every stretch with the likeness `least` to match three of them (of L places, n of which
   must match, L - n + 3). Each occurrence of such a word, with each of its postings (template, position), votes for an
   alignment: place minus position.
3. Votes are added up over neighbouring alignments, as words that were put in or left out move what follows: over
   `slack` of them, a twelfth of the template's words. Where they are enough, template and text are aligned in order, word by
   word, inside a band of `slack` alignments to either side; the share of the template's words that find
   themselves is its likeness. A template is found when the likeness reaches `least` and one of its key phrases
   stands inside the aligned stretch and the file.

The vocabulary and its counts are as long as the templates, whatever the corpus. Documents are read twice and never
shuffled; there is no cap on places or alignments.

Defined results: null and empty texts have no words, no places, empty labels and score 0; a text is judged whole; rows
that repeat are judged each by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, buffers, hash_words, map_text, slices, small_batches, word_table

#: (phrase, label). Fixed values of the query's contract.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
    "connection with the software or the use or other dealings in the software"
)
_BSD_TWO = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above "
    "copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution"
)
_BSD_WARRANTY = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
    "for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but "
    "not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or "
    "tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU_TAIL = (
    "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
    "merchantability or fitness for a particular purpose see the"
)

#: label -> (notice, key phrases of which one must stand inside it). Public licence notices: fixed values.
TEMPLATES: dict[str, tuple[str, list[str]]] = {
    "mit-full": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY,
        ["permission is hereby granted free of charge"],
    ),
    "bsd-2-clause": (_BSD_TWO + " " + _BSD_WARRANTY, ["redistributions in binary form must reproduce"]),
    "bsd-3-clause": (
        _BSD_TWO + " 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission " + _BSD_WARRANTY,
        ["endorse or promote products"],
    ),
    "isc-full": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in "
        "all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall "
        "the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or "
        "other tortious action arising out of or in connection with the use or performance of this software",
        ["with or without fee"],
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to "
        "anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must "
        "not be misrepresented you must not claim that you wrote the original software 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original "
        "software 3 this notice may not be removed or altered from any source distribution",
        ["must not be misrepresented"],
    ),
    "boost-1.0": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce "
        "display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
        ["person or organization obtaining"],
    ),
    "gpl-3.0-header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation " + _GNU_TAIL
        + " gnu general public license for more details",
        ["gnu general public license"],
    ),
    "agpl-3.0-header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation " + _GNU_TAIL
        + " gnu affero general public license for more details",
        ["affero general public license"],
    ),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and limitations under the license",
        ["unless required by applicable law"],
    ),
    "mit-line": ("released under the mit license", ["mit license"]),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ["permission is hereby granted", "without restriction"],
    ),
    "apache-2.0-line": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ["in compliance with the license", "may not use this file except"],
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ["gnu general public license", "free software foundation"],
    ),
    "gpl-line": ("licensed under the gnu general public license", ["general public license"]),
    "lgpl-notice": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ["lesser general public license"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["source and binary forms", "following conditions are met"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee"],
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    "cc-by": ("this work is licensed under the creative commons attribution", ["creative commons attribution"]),
    "all-rights-reserved": ("copyright all rights reserved", ["all rights reserved"]),
}

FIELDS = [("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]


class Index:
    """Postings of the templates' rare places, by the IDF of each word over the corpus."""

    def __init__(self, templates: dict[str, tuple[str, list[str]]], idf: dict[str, float], rare: int, least: float):
        self.labels = list(templates)
        self.words = [hash_words(t.split(), ALNUM) for t, _ in templates.values()]
        self.keys = [[hash_words(p.split(), ALNUM) for p in keys] for _, keys in templates.values()]
        vocabulary = sorted({w for t, _ in templates.values() for w in t.split()})
        h = hash_words(vocabulary, ALNUM)
        order = np.argsort(h)
        self.vocabulary = h[order]
        rank = np.array([-idf.get(vocabulary[i], 0.0) for i in order])
        ids = [np.searchsorted(self.vocabulary, w) for w in self.words]
        need = [max(1, next((n for n in range(len(w) + 1) if n / len(w) >= least), len(w))) for w in self.words]
        self.votes = [min(3, n) for n in need]
        top = [np.argsort(rank[v], kind="stable")[: max(rare, len(v) - n + k)] for v, n, k in zip(ids, need, self.votes, strict=True)]
        post = sorted((int(v[p]), k, int(p)) for k, (v, at) in enumerate(zip(ids, top, strict=True)) for p in at)
        post_word, self.post_template, self.post_place = (np.array(x, np.int64) for x in zip(*post, strict=True))
        posted, first = np.unique(post_word, return_index=True)  # words without a posting are never looked up
        self.vocabulary, self.post_at = self.vocabulary[posted], np.append(first, len(post_word))
        self.longest = max(map(len, self.words))
        self.slack = [len(w) // 12 for w in self.words]


def places(h: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """First words of a phrase's occurrences inside one document."""
    m = len(phrase)
    at = np.flatnonzero(h[: len(h) - m + 1] == phrase[0]) if len(h) >= m else np.zeros(0, np.int64)
    for k in range(1, m):
        at = at[h[at + k] == phrase[k]]
    return at[doc[at] == doc[at + m - 1]] if m > 1 else at


def in_order(h: np.ndarray, doc: np.ndarray, words: np.ndarray, start: np.ndarray, who: np.ndarray, width: int) -> np.ndarray:
    """For each stretch how many of `words` can be found in order, the i-th among the places start + i to start + i + width."""
    best = np.zeros((len(start), width + 1), np.int32)
    span = np.arange(width + 1)
    for i, w in enumerate(words):
        p = start[:, None] + i + span
        inside = (p >= 0) & (p < len(h))
        q = np.where(inside, p, 0)
        here = best + (inside & (h[q] == w) & (doc[q] == who[:, None]))
        here[:, :-1] = np.maximum(here[:, :-1], best[:, 1:])  # this word is missing
        best = np.maximum.accumulate(here, axis=1)  # a place of the text is passed over
    return best[:, -1] if len(start) else np.zeros(0, np.int32)


def alignments(h: np.ndarray, doc: np.ndarray, begin: np.ndarray, ix: Index, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, template, likeness) of the templates found; begin holds each document's first word."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    v = np.searchsorted(ix.vocabulary, h)
    v[v == len(ix.vocabulary)] = 0
    at = np.flatnonzero(ix.vocabulary[v] == h)
    if not len(at):
        return none
    v, d = v[at], doc[at]
    count = ix.post_at[v + 1] - ix.post_at[v]
    post = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ix.post_at[v], count)
    shift = np.repeat(at, count) - ix.post_place[post] + ix.longest
    wide = 2 * ix.longest + len(h) + 2 * max(ix.slack) + 2
    vote, votes = np.unique((np.repeat(d, count) * len(ix.words) + ix.post_template[post]) * wide + shift, return_counts=True)
    pair, shift = vote // wide, vote % wide - ix.longest
    template, total = pair % len(ix.words), np.concatenate([[0], np.cumsum(votes)])
    near = total[np.searchsorted(vote, vote + np.array(ix.slack)[template], side="right")] - total[np.searchsorted(vote, vote)]
    found_d, found_t, found_s = [], [], []
    for t, words in enumerate(ix.words):
        slack, reach = ix.slack[t], len(words) + 2 * ix.slack[t]
        mine = (template == t) & (near >= ix.votes[t])
        start, who = shift[mine] - slack, pair[mine] // len(ix.words)
        if not len(start):
            continue
        keyed = np.zeros(len(start), bool)
        for key in ix.keys[t]:
            spots = places(h, doc, key)
            if not len(spots):
                continue
            nearest = np.searchsorted(spots, np.maximum(start, begin[who]))  # a stretch may reach past its document's ends
            where = spots[np.minimum(nearest, len(spots) - 1)]
            keyed |= (nearest < len(spots)) & (where + len(key) <= start + reach) & (doc[where] == who)
        start, who = start[keyed], who[keyed]
        like = in_order(h, doc, words, start, who, 2 * slack) / len(words)
        good = like >= least
        found_d.append(who[good])
        found_t.append(np.full(good.sum(), t))
        found_s.append(like[good])
    return (np.concatenate(found_d), np.concatenate(found_t), np.concatenate(found_s)) if found_d else none


def scan_texts(col: pa.Array, ix: Index, phrases: list[tuple[str, str]], least: float):
    n = len(col)
    h, doc = word_table(*buffers(col), ALNUM)
    words = np.bincount(doc, minlength=n)
    begin = np.concatenate([[0], np.cumsum(words)])
    total, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    base: list[set[str]] = [set() for _ in range(n)]
    for phrase, label in phrases:
        at = places(h, doc, hash_words(phrase.split(), ALNUM))
        np.add.at(total, doc[at], 1)
        np.minimum.at(first, doc[at], at - begin[doc[at]])
        np.maximum.at(last, doc[at], at - begin[doc[at]])
        for i in np.unique(doc[at]):
            base[i].add(label)
    every = [set(x) for x in base]
    score = (total > 0).astype(float)
    for i, t, s in zip(*alignments(h, doc, begin, ix, least), strict=True):
        every[i].add(ix.labels[t])
        score[i] = max(score[i], s)
    none = total == 0
    return (
        words, total, pa.array(np.where(none, 0, first), mask=none), pa.array(np.where(none, 0, last), mask=none),
        [",".join(sorted(x)) for x in base], [",".join(sorted(x)) for x in every], score,
    )


def word_idf(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each vocabulary word over all documents; counts are added up per task before they meet."""
    picked = small_batches(docs).select(F.col(f"`{text}`").cast("string").alias("t"))
    known = np.sort(hash_words(vocabulary, ALNUM))

    def count(batches):
        held, n = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for i, j in slices(batch.column(0)):
                h, doc = word_table(*buffers(batch.column(0).slice(i, j - i)), ALNUM)
                v = np.minimum(np.searchsorted(known, h), len(known) - 1)
                on = known[v] == h
                held += np.bincount(np.unique(doc[on] * len(known) + v[on]) % len(known), minlength=len(known))
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(known))), pa.array(np.concatenate([[n], held]))], names=["v", "c"])

    got = {r.v: r.c for r in picked.mapInArrow(count, "v long, c long").groupBy("v").agg(F.sum("c").alias("c")).collect()}  # as many rows as words
    by_hash = dict(zip(hash_words(vocabulary, ALNUM).tolist(), vocabulary, strict=True))
    return {by_hash[int(known[v])]: float(np.log((got.get(-1, 0) + 1) / (c + 1))) for v, c in got.items() if v >= 0}


def scan(docs: DataFrame, *, doc_id="doc_id", text="text", phrases=PHRASES, templates=TEMPLATES, rare=12, least=0.6) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = sorted({w for t, _ in templates.values() for w in t.split()})
    ix = docs.sparkSession.sparkContext.broadcast(Index(templates, word_idf(docs, text, vocabulary), rare, least))
    return map_text(docs, text, {doc_id: doc_id}, FIELDS, lambda col: scan_texts(col, ix.value, phrases, least))
