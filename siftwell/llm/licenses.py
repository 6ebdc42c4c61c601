"""Licence scans with a positional index of rare tokens.

Templates are passages of licences: notices, grants, titles, statements. Of each, the rarest words, by their document
frequency in the scanned corpus, are indexed with their positions. A text's words that are in the index vote for where
a template would begin. Enough words are indexed that wherever LEAST_SHARE of a template's words stand in order, some of
them do: a place differs in so few words that not all indexed ones are hit. Words put in or left out move what follows,
so votes for neighbouring beginnings count together, as far apart as the words that may differ allow. Such places are
aligned word by word, and count if enough words match and all mandatory phrases of the passage stand there in full. The
fixed phrases are looked up by their rarest word in the same pass."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import ids_and_texts, sliced, texts

#: Of lower-cased bytes: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ keeps digits, a-z and all that isn't ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrase and label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Passages of licences: label, passage, phrases of it that must stand in full (separated by |).
TEMPLATES = (
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public license|version 3"),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gnu general public license version 3"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license version 3"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general public license|version 2"),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "gnu general public license version 2"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public license version 2"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "gnu lesser general public license|version 2 1"),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gnu lesser general public license version 3"),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu affero general public license"),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "gnu affero general public license version 3"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "apache license version 2 0"),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "without warranties or conditions of any kind"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache license version 2 0"),
    ("mit-release", "Released under the MIT License.", "mit license"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software', "permission is hereby granted free of charge"),
    ("mit-grant", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "all copies or substantial portions of the software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "redistributions of source code must retain"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "may be used to endorse or promote products derived from this software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla public license v 2 0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", "cc by 4 0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4 0 international"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial 4 0 international"),
    ("cc0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.", "to the public domain worldwide"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "in no event will the authors be held liable"),
)
LEAST_SHARE = 0.8
#: Votes that a place needs; so many more words of a template are indexed than may differ.
LEAST_VOTES = 3
#: Words that may be put in besides those that take the place of others.
SLACK = 4


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def split_phrase(phrase: str) -> tuple[bytes, ...]:
    return tuple(w.encode() for w in phrase.lower().split())


def misses(words: int) -> int:
    """How many of a template's words may differ."""
    return words - math.ceil(words * LEAST_SHARE)


def band(words: int) -> int:
    """How far apart the beginnings may be that a template's words in one place stand for."""
    return 2 * misses(words) + SLACK


def aligned(words: list[bytes], template: tuple[bytes, ...], begin: int) -> int:
    """How many words of the template stand in the text in order, each up to a band behind its place from begin on."""
    width = band(len(template))
    best = [0] * (width + 2)  # by how far behind, the last for what is too far
    for k, word in enumerate(template):
        now, left = [0] * (width + 2), 0
        for d in range(width + 1):
            at = begin + k + d
            there = best[d] + 1 if 0 <= at < len(words) and words[at] == word else 0
            left = now[d] = max(left, best[d + 1], there)
        best = now
    return max(best)


class Index:
    def __init__(self, document_counts: dict[bytes, int], documents: int, templates=TEMPLATES, phrases=PHRASES):
        idf = lambda w: math.log((documents + 1) / (document_counts.get(w, 0) + 1))
        rarest = lambda words, n: sorted(range(len(words)), key=lambda k: (-idf(words[k]), k))[:n]
        self.templates = [(label, tuple(words_of(t.encode())), [split_phrase(p) for p in keys.split("|")]) for label, t, keys in templates]
        self.phrases = [(split_phrase(p), label) for p, label in phrases.items()]
        self.rare: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[int] = []
        for t, (_, words, _) in enumerate(self.templates):
            indexed = rarest(words, misses(len(words)) + LEAST_VOTES)
            self.needed.append(len(indexed) - misses(len(words)))
            for k in indexed:
                self.rare[words[k]].append((t, k))
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for p, (words, _) in enumerate(self.phrases):
            k = rarest(words, 1)[0]
            self.anchors[words[k]].append((p, k))
        self.wanted = frozenset(self.rare) | frozenset(self.anchors)

    def share(self, words: list[bytes], t: int, votes: list[tuple[int, int]]) -> float:
        """The largest share of template t that stands in one place, of those that are enough and have the mandatory
        phrases; 0 if there is none. votes: beginnings and positions in the template."""
        _, template, keys = self.templates[t]
        width, size = band(len(template)), len(template)
        least, best, tried, votes = math.ceil(size * LEAST_SHARE), 0, set(), sorted(votes)
        low, inside = 0, Counter()
        for high, (last, k) in enumerate(votes):
            inside[k] += 1
            while last - votes[low][0] > width:
                inside[votes[low][1]] -= 1
                inside += Counter()  # without zeros
                low += 1
            if len(inside) < self.needed[t]:
                continue
            for begin in range(last - width, votes[low][0] + 1):
                if begin in tried or best == size:
                    continue
                tried.add(begin)
                span = words[max(0, begin) : begin + size + width]
                if all(any(tuple(span[j : j + len(key)]) == key for j in range(len(span) - len(key) + 1)) for key in keys) and (n := aligned(words, template, begin)) >= least:
                    best = max(best, n)
        return best / size

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = words_of(text)
        base, starts, votes = set(), [], defaultdict(list)
        if not self.wanted.isdisjoint(words):
            for at, word in enumerate(words):
                if word in self.wanted:
                    for p, k in self.anchors.get(word, ()):
                        phrase, label = self.phrases[p]
                        if at >= k and tuple(words[at - k : at - k + len(phrase)]) == phrase:
                            starts.append(at - k)
                            base.add(label)
                    for t, k in self.rare.get(word, ()):
                        votes[t].append((at - k, k))
        found, score = set(), 1.0 if base else 0.0
        for t, own in votes.items():
            if len({k for _, k in own}) >= self.needed[t] and (share := self.share(words, t, own)):
                found.add(self.templates[t][0])
                score = max(score, share)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score


def vocabulary(templates=TEMPLATES, phrases=PHRASES) -> frozenset[bytes]:
    return frozenset(w for _, t, _ in templates for w in words_of(t.encode())) | frozenset(w for p in phrases for w in split_phrase(p))


def document_counts(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each licence word occurs, and the number of documents. The words are those of the
    templates, so what comes to the driver has a fixed bound."""
    wanted = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches, 1):
            for text in texts(batch.column(1)):
                counts[b""] += 1
                counts.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = ids_and_texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base (places of the fixed phrases, overlapping ones too), first_word and
    last_word (smallest and largest start of such a place, words from 0; else null), base_labels, labels (those and the
    templates'; both distinct, sorted, comma-joined), score (1 for a fixed phrase, else the best template's share of
    matching words; else 0).

    Null, empty and wordless texts have no words and no labels. Repeated rows and null ids each give a row. Columns other
    than doc_id and text play no part. An empty table gives no rows."""
    counts, documents = document_counts(docs)
    index = Index(counts, documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            columns = list(zip(*map(index.scan, texts(batch.column(1))))) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], SCHEMA.names)

    return ids_and_texts(docs).mapInArrow(run, SCHEMA)
