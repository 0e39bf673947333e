"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs and digit substitutions become
the Latin letters they stand for, everything but letters becomes one space.
The lexicon holds whole words and word beginnings with weights learned from
labelled rows.  The automaton finds all entries; inside a word the longest
entry counts.  The weights' sum, normalised by the text's length in words, goes
through a logistic curve fitted on the same labelled rows.  Exception phrases
are entries of their own: a lexicon hit inside one does not count.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemscore.llm.common import hash_share, pylists, record_batch, release, shipped, sliced, small, stage

#: Look-alike letters, and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a lexicon word is no attack.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "recycle trash", "sore loser board")

#: Bounds of the fit: labelled rows (chosen by a hash when there are more),
#: lexicon entries, and documents an entry must be in.
FIT_ROWS = 50_000
LEXICON = 4_000
MIN_DOCS = 5
#: An entry in this share of the toxic training texts needs the least log-odds; one in
#: fewer needs as much of the lower bound, this many standard errors below its log-odds.
MIN_SHARE = 0.01
ERRORS = 1.645
#: Least log-odds of an entry (e^3: twenty times likelier in toxic texts).
MIN_WEIGHT = 3.0
PREFIXES = (4, 5, 6, 7, 8)
#: Entries a worker counts before it hands its counts on (bounds its memory).
COUNTED = 150_000
#: Words of a text that count as one when a sum is normalised.
LENGTH_POWER = 0.25


def _fold_table() -> dict[int, str]:
    # Full-width forms stand at a fixed distance from ASCII.
    table = {0xFEE0 + c: chr(c).lower() for c in range(0x21, 0x7F)}
    table.update({ord(k): v for k, v in HOMOGLYPHS.items()})
    return table


_FOLD = _fold_table()
_DIGITS = str.maketrans(SUBSTITUTIONS)


def fold(text: str) -> list[str]:
    """Folded words.  Signs for letters are folded only in words that hold a letter."""
    lowered = text.lower()
    if not lowered.isascii():
        lowered = lowered.translate(_FOLD)
    out = []
    for raw in lowered.split():
        if raw.isalpha():
            out.append(raw)
            continue
        core = raw.strip(".,;:!?\"'()[]{}<>*_-#|/\\~`")
        if not core.isalpha():
            if any(map(str.isalpha, core)):
                core = core.translate(_DIGITS)
            out.extend("".join(c if c.isalpha() else " " for c in core).split())
        else:
            out.append(core)
    return out


def entries(words: list[str]) -> set[str]:
    """What a text can teach: ' word ' for words, ' beginning' for word beginnings."""
    distinct = set(words)
    out = {f" {w} " for w in distinct}
    for n in PREFIXES:
        out.update(f" {w[:n]}" for w in distinct if len(w) > n)
    return out


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == 0


class Lexicon:
    """Weighted entries with their automaton, and the fitted curve."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, float] = (1.0, 0.0)):
        self.weights, self.curve = weights, curve
        self.automaton = ahocorasick.Automaton()
        for entry, w in weights.items():
            self.automaton.add_word(entry, (entry, w))
        for phrase in EXCEPTIONS:
            self.automaton.add_word(f" {phrase} ", (f" {phrase} ", None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def raw(self, text: str) -> float:
        """Normalised sum of the longest hits of each word."""
        words = fold(text)
        if not words or not len(self.automaton):
            return 0.0
        joined = f" {' '.join(words)} "
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (entry, w) in self.automaton.iter(joined):
            begin = end - len(entry) + 1
            if w is None:
                spared.append((begin, end))
            elif len(entry) > best.get(begin, (0, 0.0))[0]:
                best[begin] = (len(entry), w)
        total = sum(w for at, (_, w) in best.items() if not any(a <= at < b for a, b in spared))
        return total / len(words) ** LENGTH_POWER

    def score(self, text: str) -> float:
        slope, middle = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, slope * (self.raw(text) - middle)))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5) -> Lexicon:
    """Learn weights and curve from labelled rows outside the held-out fold.

    At most about ``fit_rows`` labelled rows are used (a documented bound;
    chosen by a hash of doc_id).  Weights are smoothed log-odds of an entry in
    toxic against other documents; only entries that speak for toxicity are
    kept, the ``LEXICON`` strongest by weight times documents.  Without rows of
    both kinds the lexicon is empty and every score below 0.5.
    """
    labels = (labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)")
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != 0))
    n = labels.count()
    if n > fit_rows:
        labels = labels.where(hash_share(F.xxhash64("doc_id"), fit_rows / n))
    # Copies of a text teach once, or a copied text's rare words would look like a habit.  Only keys are
    # gathered for it; the texts themselves are read where they lie and never shuffled.
    labels = stage(labels, "toxicity-labels")
    text_key = F.xxhash64("text")
    docs = shipped(docs).select("doc_id", "text").where("text is not null")
    keys = stage(docs.select("doc_id", text_key.alias("key")).join(small(labels), "doc_id").groupBy("key")
                 .agg(F.min("doc_id").alias("teacher"), F.max("toxic").alias("toxic")), "toxicity-keys")
    rows = (docs.join(small(keys), (F.col("doc_id") == F.col("teacher")) & (text_key == F.col("key")))
            .select("text", "toxic"))
    schema = pa.schema([("toxic", pa.int32()), ("entry", pa.string()), ("n", pa.int64())])

    def count(batches):
        seen = {0: Counter(), 1: Counter()}

        def out():
            for toxic, c in seen.items():
                yield record_batch(schema, ([toxic] * len(c), list(c), list(c.values())))
                c.clear()

        for batch in sliced(batches, "text"):
            texts, toxic = pylists(batch, "text", "toxic")
            for text, t in zip(texts, toxic, strict=True):
                seen[t].update(entries(fold(text or "")))
                seen[t][""] += 1
                if len(seen[t]) > COUNTED:
                    yield from out()
        yield from out()
        release()

    counts = (rows.mapInArrow(count, "toxic int, entry string, n long").groupBy("entry")
              .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"),
                   F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg")))
    counts = counts.where((F.col("pos") >= MIN_DOCS) | (F.col("entry") == ""))
    # The rows' sums stand under the empty entry; one small row joined by value.
    top = counts.orderBy((F.col("entry") == "").desc(),
                         ((F.col("pos") - F.col("neg")) / F.sqrt(F.col("pos") + F.col("neg"))).desc(),
                         "entry").limit(20 * LEXICON + 1).collect()
    sums = next((r for r in top if r.entry == ""), None)
    if sums is None or not sums.pos or not sums.neg:
        return Lexicon({}, (1.0, 1e3))
    weigh = lambda r: math.log((r.pos + 0.5) / (sums.pos + 1)) - math.log((r.neg + 0.5) / (sums.neg + 1))
    error = lambda r: 0.0 if r.pos >= MIN_SHARE * sums.pos else math.sqrt(1 / (r.pos + 0.5) + 1 / (r.neg + 0.5))
    found = [(weigh(r), r) for r in top if r.entry]
    found = [(w, r) for w, r in found if w - ERRORS * error(r) >= MIN_WEIGHT]
    found = sorted(found, key=lambda x: (-x[0] * x[1].pos, x[1].entry))[:LEXICON]
    lexicon = Lexicon({r.entry: w for w, r in found})
    return Lexicon(lexicon.weights, _curve(rows, lexicon))


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """(slope, middle): the middle parts the labelled rows with the fewest errors."""
    schema = pa.schema([("bin", pa.int64()), ("toxic", pa.int32()), ("n", pa.int64())])
    weights = lexicon.weights

    def bins(batches):
        seen, lex = Counter(), Lexicon(weights)
        for batch in sliced(batches, "text"):
            texts, toxic = pylists(batch, "text", "toxic")
            seen.update((min(int(lex.raw(x or "") * 64), 1 << 20), t) for x, t in zip(texts, toxic, strict=True))
        yield record_batch(schema, ([k[0] for k in seen], [k[1] for k in seen], list(seen.values())))

    found = (rows.mapInArrow(bins, "bin long, toxic int, n long").groupBy("bin", "toxic")
             .agg(F.sum("n").alias("n")).orderBy("bin").collect())
    if not found:
        return 1.0, 1e3
    levels = sorted({r.bin for r in found})
    pos, neg = Counter(), Counter()
    for r in found:
        (pos if r.toxic else neg)[r.bin] += r.n
    below = np.cumsum([0] + [pos[b] for b in levels])
    above = sum(neg.values()) - np.cumsum([0] + [neg[b] for b in levels])
    errors = below + above                                   # split before levels[i]
    i = len(levels) - int(np.argmin(errors[::-1]))
    low = levels[i - 1] if i else levels[0] - 64
    high = levels[i] if i < len(levels) else levels[-1] + 64
    return 2.0, max((low + 1 + high) / 2 / 64, 1 / 64)


def score(docs: DataFrame, lexicon: Lexicon, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every row.

    Null and empty texts score as texts without hits.  Repeated rows and null
    ids stay (a null id counts as the text 'None' for held_out); other columns
    are ignored; an empty table gives no rows.
    """
    weights, curve = lexicon.weights, lexicon.curve
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                        ("predicted", pa.int32())])

    def run(batches):
        lex = Lexicon(weights, curve)
        for batch in sliced(batches, "text"):
            keys, texts = pylists(batch, "doc_id", "text")
            s = [lex.score(t or "") for t in texts]
            yield record_batch(schema, (keys, [held_out(k, folds) for k in keys], s, [int(x >= 0.5) for x in s]))

    return shipped(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below 0.5."""
    weights, curve = lexicon.weights, lexicon.curve
    place = docs.columns.index("text")

    def run(batches):
        lex = Lexicon(weights, curve)
        for batch in sliced(batches, "text"):
            texts = batch.column(place).to_pylist()
            yield batch.filter(pa.array([lex.score(t or "") < 0.5 for t in texts], pa.bool_()))

    return shipped(docs).mapInArrow(run, docs.schema)
