"""License scans by a positional rare-token index.

The index holds, for each licence template, the places of its rarest words
(highest IDF over all documents).  A file's licence words are looked up, the
postings are intersected by relative position (place in the file minus place
in the template, which may differ by the words between): the key phrase's
rarest word must be met by RARE_WORDS - 1 further posted words.  So many words
are posted that no place with MIN_SHARE of its words is lost by that.  Each
surviving place is verified: the template's key
phrase must stand there word for word, and the share of template words that
stand before and after it in their order, with at most SLACK other words
between them on each side, is the score.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemscore.llm.common import pylists, record_batch, shipped, text_slices

#: Phrases whose every place counts, with their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Fixed values: (label, key phrase that must stand word for word, template).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license"),
    ("gpl", "gnu general public license",
     "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
     "the free software foundation"),
    ("gpl", "licensed under the gnu general public license",
     "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license",
     "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met"),
    ("mpl", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted"),
    ("unlicense", "free and unencumbered software",
     "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
)
#: Words that make the key phrase before them another licence's.
OTHERS = {"creative commons attribution": ("noncommercial", "non", "sharealike", "share", "noderivatives", "noderivs", "no")}
#: Rare words of a template that are posted, and the least share of words in order.
RARE_WORDS = 4
MIN_SHARE = 0.75
#: Other words that may stand between a template's words on each side of its key phrase.
SLACK = 8

_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_FOLD = bytes(_WORD_BYTES[b] + 32 if 65 <= b <= 90 else _WORD_BYTES[b] for b in range(256))


def words(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased: runs of a-z, 0-9 and non-ASCII characters."""
    return text.encode().translate(_FOLD).split()


def _patterns() -> list[tuple[str, list[bytes], list[bytes], bool]]:
    """(label, words, key phrase, base) of all base phrases and templates."""
    out = [(label, words(p), words(p), True) for p, label in BASE_PHRASES.items()]
    return out + [(label, words(t), words(k), False) for label, k, t in TEMPLATES]


def _masks(ws: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """(words, places of each word as bits) of one side of a template."""
    masks: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(ws):
        masks[w] |= 1 << i
    return len(ws), dict(masks)


def _in_order(side: tuple[int, dict[bytes, int]], window: list[bytes]) -> int:
    """Longest common subsequence of a template's side and a window, by bits."""
    n, masks = side
    v = full = (1 << n) - 1
    for w in window:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """(documents, documents that hold each licence word), over all documents.

    One count per licence word and task leaves the tasks (a fixed vocabulary).
    """
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        vocabulary = frozenset(w for _, ws, _, _ in _patterns() for w in ws)
        seen: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in pylists(batch, "text")[0]:
                seen[b""] += 1
                for w in vocabulary.intersection(words(text or "")):
                    seen[w] += 1
        yield record_batch(schema, (list(seen), list(seen.values())))

    rows = (docs.select("text").mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    found = {bytes(r.word): r.n for r in rows}
    return found.pop(b"", 0), found


class LicenseIndex:
    """Positional postings of the rarest words of every phrase and template."""

    def __init__(self, n_docs: int, df: dict[bytes, int], rare_words: int = RARE_WORDS,
                 min_share: float = MIN_SHARE):
        self.patterns, self.min_share = _patterns(), min_share
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        idf = lambda w: math.log((n_docs + 1) / (df.get(w, 0) + 1))
        self.key_at, self.sides, self.rarest, self.near, self.least = [], [], [], [], []
        self.others = {tuple(words(k)): frozenset(w.encode() for w in ws) for k, ws in OTHERS.items()}
        for p, (_, ws, key, base) in enumerate(self.patterns):
            place = next(i for i in range(len(ws)) if ws[i:i + len(key)] == key)
            self.key_at.append(place)
            self.sides.append((_masks(ws[:place]), _masks(ws[place + len(key):])))
            # The key phrase's rarest word stands at every place that verifies.  A template may lack
            # ``missing`` of its words there, so of that many more posted words the rare_words are met.
            rarest = max(range(place, place + len(key)), key=lambda i: (idf(ws[i]), -i))
            others = sorted((i for i in range(len(ws)) if i != rarest), key=lambda i: (-idf(ws[i]), i))
            missing = next(m for m in range(len(ws), -1, -1) if not m or (len(ws) - m) / len(ws) >= min_share)
            posted = [rarest, *([] if base else others[:rare_words + missing - 1])]
            for i in posted:
                self.postings[ws[i]].append((p, i))
            self.rarest.append(rarest)
            self.near.append(SLACK + len(ws))                # farthest apart of two words' relative positions
            self.least.append(max(1, len(posted) - missing))
        self.key_words = frozenset(ws[i] for (_, ws, _, _), i in zip(self.patterns, self.rarest, strict=True))
        self.words = frozenset(self.postings)

    def places(self, ws: list[bytes]):
        """(pattern, place of its start) where its key word is met by enough of its other posted words."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, w in enumerate(ws):
            if w in self.words:
                for p, i in self.postings[w]:
                    found[p].append((at - i, i))
        for p, votes in found.items():
            starts = [at for at, i in votes if i == self.rarest[p]]
            if self.least[p] > 1 and starts:
                votes.sort()
            low = high = 0
            for at in starts:
                if self.least[p] > 1:
                    while votes[low][0] < at - self.near[p]:
                        low += 1
                    while high < len(votes) and votes[high][0] <= at + self.near[p]:
                        high += 1
                    if len({i for _, i in votes[low:high]}) < self.least[p]:
                        continue
                yield p, at

    def _share(self, p: int, ws: list[bytes], k: int) -> float:
        """Share of the template's words that stand in order around its key phrase at ``k``."""
        _, pattern, key, _ = self.patterns[p]
        before, after = self.sides[p]
        end = k + len(key)
        if ws[end:end + 1] and ws[end] in self.others.get(tuple(key), ()):
            return 0.0
        found = (_in_order(before, ws[max(0, k - before[0] - SLACK):k]) if before[0] else 0) + \
            (_in_order(after, ws[end:end + after[0] + SLACK]) if after[0] else 0)
        return (len(key) + found) / len(pattern)

    def scan(self, text: str) -> tuple[int, list[int], set[str], set[str], float]:
        """(words, starts of base places, base labels, all labels, score)."""
        ws = words(text)
        starts, base, labels, score = [], set(), set(), 0.0
        if not self.key_words.isdisjoint(ws):
            for p, at in self.places(ws):
                label, _, key, is_base = self.patterns[p]
                k = at + self.key_at[p]
                if k < 0 or ws[k:k + len(key)] != key:
                    continue
                share = self._share(p, ws, k)
                if is_base:
                    starts.append(at)
                    base.add(label)
                elif share < self.min_share:
                    continue
                labels.add(label)
                score = max(score, share)
        return len(ws), starts, base, base | labels, score


def scan(docs: DataFrame, rare_words: int = RARE_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels (distinct, sorted, comma-joined) and score,
    the largest share of a phrase's or template's words in order (0 to 1).

    Null and empty texts
    have 0 words, null first and last word, empty labels and score 0.
    Repeated rows and null ids stay; other columns are ignored; an empty table
    gives no rows.
    """
    docs = shipped(docs).select(F.col("doc_id").cast("long"), "text")
    n_docs, df = document_frequencies(docs)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(batches):
        index = LicenseIndex(n_docs, df, rare_words, min_share)
        for batch in batches:
            ids, texts = pylists(batch, "doc_id", "text")
            for start, part in text_slices(texts):
                found = [index.scan(t) for t in part]
                yield record_batch(schema, (
                    ids[start:start + len(part)], [f[0] for f in found], [len(f[1]) for f in found],
                    [min(f[1], default=None) for f in found], [max(f[1], default=None) for f in found],
                    [",".join(sorted(f[2])) for f in found], [",".join(sorted(f[3])) for f in found],
                    [f[4] for f in found]))

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                "base_labels string, labels string, score double")
