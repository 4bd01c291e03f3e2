"""Licence scans by a generalised suffix automaton of licence words.

The automaton holds every run of words of every template. A text is streamed through it: after each word, the state and
the length say the longest run that ends there and stands in a template (the matching statistics). Runs of LEAST_MATCH
words and more are matches; each template's matches are chained in order, and what the best chain covers of the template is
its score. Words that no template has lead to the root, so only stretches of two or more known words are walked.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import NOT_ALNUM, small_batches, views, words

# Phrases that name a licence, opening words of common licence notices, and whole texts of short licences.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("gpl", """this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
      see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see"""),
    ("apache", """unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
      either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including
      without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
      following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any
      kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable
      for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("mit", """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no
      event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
      or the use or other dealings in the software"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above
      copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in
      the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
      from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
      the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special
      exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
      liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all
      copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be
      liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
      arising out of or in connection with the use or performance of this software"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone
      to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be
      misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2
      altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"""),
    ("bsl", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display
      distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the
      copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in
      part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a
      compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
      in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of
      relinquishment in perpetuity of all present and future rights to this software under copyright law"""),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]
LEAST_MATCH = 3  # words
LEAST_COVER = 0.6  # of a template


class Automaton:
    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for k, w in enumerate(sequence):
                last = self._extend(last, w)
                self.ends[last].add((t, k + 1))
        for v in sorted(range(1, len(self.size)), key=lambda x: -self.size[x]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _new(self, size: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.size.append(size)
        self.ends.append(set())
        return len(self.size) - 1

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            if self.size[q] == self.size[last] + 1:
                return q
            return self._split(last, q, w)
        v, p = self._new(self.size[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = v
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[v] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
        return v

    def _split(self, p: int, q: int, w: int) -> int:
        c = self._new(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def step(self, v: int, length: int, w: int) -> tuple[int, int]:
        while v and w not in self.next[v]:
            v = self.link[v]
            length = self.size[v]
        return (self.next[v][w], length + 1) if w in self.next[v] else (0, 0)


def shortest(automaton: Automaton) -> list[int]:
    """For each state, the one on its way to the root whose runs have the last LEAST_MATCH words of its own."""
    out = []
    for v in range(len(automaton.size)):
        while v > 0 and automaton.size[automaton.link[v]] >= LEAST_MATCH:
            v = automaton.link[v]
        out.append(v)
    return out


class Scanner:
    def __init__(self) -> None:
        all_ = [text.split() for _, text in PHRASES + TEMPLATES]
        known = sorted({w for t in all_ for w in t})
        raw = [w.encode() for w in known]
        offsets = np.cumsum([0, *map(len, raw)])
        hashes = words(np.frombuffer(b"".join(raw), np.uint8), offsets, NOT_ALNUM)[0]
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        at = {w: k for k, w in enumerate(known)}
        self.sequences = [[at[w] for w in t] for t in all_]
        self.automaton = Automaton(self.sequences)
        n = len(PHRASES)
        self.phrases: list[tuple[tuple[int, int], ...]] = []  # of a state: (phrase, its length) that end where its runs end
        for v in range(len(self.automaton.size)):
            found = []
            u, most = v, self.automaton.size[v]
            while u > 0:
                found += [(t, k) for t, k in self.automaton.ends[u] if t < n and k == len(self.sequences[t]) and self.automaton.size[self.automaton.link[u]] < k <= min(most, self.automaton.size[u])]
                u = self.automaton.link[u]
            self.phrases.append(tuple(set(found)))
        self.shortest = shortest(self.automaton)

    def scan(self, ids: list[int], first: int, places: list[tuple[int, int]], matches: list[tuple[int, int, int]]) -> None:
        """Walks known words that stand together from `first` on; adds (phrase, start) and (end, length, state).

        Wherever the longest run reaches LEAST_MATCH words, its last ones are a match, by the state that stands for just
        these: a run of one template may go on where that of another ends, or reach further back."""
        step, phrases, shortest = self.automaton.step, self.phrases, self.shortest
        v = length = 0
        for k, w in enumerate(ids):
            v, length = step(v, length, w)
            if length >= LEAST_MATCH:
                matches.append((first + k + 1, LEAST_MATCH, shortest[v]))
            for t, size in phrases[v]:
                if length >= size:
                    places.append((t, first + k + 1 - size))

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end word, share of the template) of each template's best chain of matches.

        A match says which word of the text is which word of a template. The best chain takes the most words of the template
        in order, each from a word of the text further on: a longest increasing subsequence of such pairs, so matches that
        overlap are cut where it pays."""
        pairs: dict[int, set[tuple[int, int]]] = {}
        for end, length, state in matches:
            for t, at in self.automaton.ends[state]:
                if t >= len(PHRASES):
                    pairs.setdefault(t, set()).update((end - k, k - at) for k in range(1, min(length, at) + 1))
        out = []
        for t, found in pairs.items():
            # Template places are negated back here: of pairs of one text word the furthest place comes first, so a chain has one.
            tails: list[int] = []
            at_tail: list[tuple[int, int]] = []  # (text word, first text word of the chain) by length
            for i, minus in sorted(found):
                j = -minus
                k = bisect_left(tails, j)
                first = at_tail[k - 1][1] if k else i
                if k == len(tails):
                    tails.append(j)
                    at_tail.append((i, first))
                else:
                    tails[k], at_tail[k] = j, (i, first)
            out.append(((PHRASES + TEMPLATES)[t][0], at_tail[-1][1], at_tail[-1][0] + 1, len(tails) / len(self.sequences[t])))
        return out


_scanner: list[Scanner] = []


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of PHRASES; labels adds templates of which a chain covers LEAST_COVER. score is 1 with a
    phrase, else the largest share covered. spans holds (label, first_word, end_word, covered) of each chain. Null texts
    have no words: counts and score 0, places null, labels "". Null ids and repeated rows stay; an empty table gives an
    empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        s = _scanner[0]
        for batch in batches:
            for lo, hi, data, offsets in views(batch.column(1)):
                hashes, _, first = words(data, offsets, NOT_ALNUM)
                at = np.minimum(np.searchsorted(s.hashes, hashes), len(s.hashes) - 1)
                known = s.hashes[at] == hashes
                ids = s.number[at]
                n = hi - lo
                places: list[list] = [[] for _ in range(n)]
                matches: list[list] = [[] for _ in range(n)]
                begin, end = known.copy(), known.copy()
                begin[1:] &= ~known[:-1]
                end[:-1] &= ~known[1:]
                cuts = first[:-1][first[:-1] < len(known)]
                begin[cuts] = known[cuts]
                cuts = first[1:][first[1:] > 0] - 1
                end[cuts] = known[cuts]
                a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
                a, b = a[b - a > 1], b[b - a > 1]
                rows = np.searchsorted(first, a, "right") - 1
                for x, y, r in zip(a.tolist(), b.tolist(), rows.tolist(), strict=True):
                    s.scan(ids[x:y].tolist(), x - int(first[r]), places[r], matches[r])
                out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
                for r in range(n):
                    starts = [x for _, x in places[r]]
                    base = {PHRASES[t][0] for t, _ in places[r]}
                    spans = s.chains(matches[r]) if matches[r] else []
                    out["n_words"].append(int(first[r + 1] - first[r]))
                    out["n_base"].append(len(starts))
                    out["first_word"].append(min(starts, default=None))
                    out["last_word"].append(max(starts, default=None))
                    out["base_labels"].append(",".join(sorted(base)))
                    out["labels"].append(",".join(sorted(base | {x[0] for x in spans if x[3] >= LEAST_COVER})))
                    out["score"].append(1.0 if starts else max((x[3] for x in spans), default=0.0))
                    out["spans"].append([{"label": x[0], "first_word": x[1], "end_word": x[2], "covered": x[3]} for x in spans])
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, end_word: long, covered: double>>")
