"""Ranked lexical search by the Best Position Algorithm.

Documents are cut to their postings of the queries' terms (term, occurrences),
from which the corpus counts follow; then blocks of postings become impact
lists, one per term, sorted by falling impact.  A search reads its lists from
the top in growing steps.  Every document met is looked up in all lists at once
(direct access), which also tells its position there.  A list's best position
is the last one up to which every position has been seen, by reading or by look-
up; what is unseen scores at most the sum of the impacts behind the best
positions.  A search stops when that sum is strictly below its k-th best score,
so documents of equal score are never lost.

A document's score needs no other document's postings, so blocks are searched
where they lie: a task carries the best k of each query from block to block (a
later block starts with that k-th score), and only they are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chemscore.llm.common import pylists, record_batch, shipped, stage, text_slices
from chemscore.operators.joins import measured

#: Query text that is searched for at once; more is searched in further passes.
QUERY_BYTES = 16 << 20
#: Postings of a block, and positions that the first step reads of each list.
BLOCK_POSTINGS = 1_000_000
FIRST_STEP = 16
# Letters and digits of ASCII and all bytes of other characters stay; A-Z is lower-cased.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass(frozen=True)
class Queries:
    """Items of one pass: ids, and their terms as numbers of the vocabulary with repeats counted."""
    items: list
    wanted: list[dict[int, int]]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows) -> Queries:
        vocabulary: dict[bytes, int] = {}
        wanted = [{vocabulary.setdefault(t, len(vocabulary)): n for t, n in Counter(terms(r.text)).items()} for r in rows]
        return cls([r.item_id for r in rows], wanted, vocabulary)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: n counts all its
    terms, the arrays hold those of the vocabulary."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                        ("counts", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids, texts = pylists(batch, "doc_id", "text")
            for start, part in text_slices(texts):
                out = []
                for key, text in zip(ids[start:start + len(part)], part, strict=True):
                    words = terms(text)
                    if words:
                        held = {vocabulary[t]: n for t, n in Counter(words).items() if t in vocabulary}
                        out.append((key, len(words), list(held), list(held.values())))
                if out:
                    yield record_batch(schema, list(zip(*out, strict=True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, terms array<int>, counts array<long>")


@dataclass(frozen=True)
class Corpus:
    """Counts over all documents: how many hold a term, all terms, and weights of the vocabulary."""
    n_docs: int
    n_terms: int
    weights: np.ndarray

    @classmethod
    def of(cls, posted: DataFrame, size: int) -> Corpus:
        total = posted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        held = posted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()   # the vocabulary's rows
        weights = np.zeros(size, np.int64)
        for r in held:
            weights[r.term] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * r["count"] + 1)))
        return cls(total.docs, total.terms or 0, weights)

    def impacts(self, term: np.ndarray, count: np.ndarray, n: np.ndarray) -> np.ndarray:
        longer = 75 + (25 * n * self.n_docs) // self.n_terms
        return self.weights[term] * ((1_000_000_000 * count) // (1000 * count + 12 * longer))


class ImpactLists:
    """A block's impact lists: per term the documents by falling impact, and each document's place in them."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        keep = impact > 0
        doc, term, impact = doc[keep], term[keep], impact[keep]
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]                 # per term by document: direct access
        falling = np.lexsort((doc, -impact, term))
        self.read = doc[falling]                                          # per term by impact: sorted access
        self.falls = impact[falling]
        bounds = np.searchsorted(term[order], np.arange(size + 1))
        self.begin, self.end = bounds[:-1], bounds[1:]
        rank = np.empty(len(doc), np.int64)
        rank[falling] = np.arange(len(doc))
        self.place = rank[order]                                          # position in the falling order

    def look_up(self, term: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the docs the list holds, where they stand in the order by document)."""
        begin, end = self.begin[term], self.end[term]
        at = begin + np.searchsorted(self.doc[begin:end], docs)
        inside = np.flatnonzero(at < end)
        inside = inside[self.doc[at[inside]] == docs[inside]]
        return inside, at[inside]


class Best:
    """The k best (score, doc_id) of a query so far; equal scores by the smaller id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> int:
        """What a document must reach: the k-th score, or anything above 0."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.floor()
        if good.any():
            score, doc = np.concatenate((self.score, score[good])), np.concatenate((self.doc, doc[good]))
            first = np.lexsort((doc, -score))[:self.k]
            self.score, self.doc = score[first], doc[first]


def best_positions(lists: ImpactLists, wanted: dict[int, int], ids: np.ndarray, best: Best,
                   step: int = FIRST_STEP) -> int:
    """Search one block for one query; returns how many documents were scored."""
    held = [(t, n) for t, n in wanted.items() if lists.end[t] > lists.begin[t]]
    begin = np.array([lists.begin[t] for t, _ in held], np.int64)
    end = np.array([lists.end[t] for t, _ in held], np.int64)
    times = np.array([n for _, n in held], np.int64)
    seen = [np.zeros(e - b, bool) for b, e in zip(begin, end, strict=True)]
    unseen = np.zeros(len(held), np.int64)                                # places behind the best positions
    scored = np.empty(0, np.int64)
    depth = 0
    while True:
        open_ = begin + unseen < end
        bound = int((times[open_] * lists.falls[(begin + unseen)[open_]]).sum())
        if bound < best.floor():                                          # strictly: ties of the k-th score are met
            return len(scored)
        met = np.unique(np.concatenate([lists.read[min(b + depth, e):min(b + depth + step, e)]
                                        for b, e in zip(begin, end, strict=True)]))
        fresh = np.setdiff1d(met, scored, assume_unique=True)
        if len(fresh):
            total = np.zeros(len(fresh), np.int64)
            for i, (t, n) in enumerate(held):
                which, at = lists.look_up(t, fresh)
                total[which] += n * lists.impact[at]
                seen[i][lists.place[at] - begin[i]] = True
            best.add(total, ids[fresh])
            scored = np.union1d(scored, fresh)
        for i in range(len(held)):
            rest = seen[i][unseen[i]:]
            unseen[i] += int(np.argmin(rest)) if not rest.all() else len(rest)
        depth, step = depth + step, 2 * step


def _search(batches, queries: Queries, corpus: Corpus, k: int, block_postings: int, schema: pa.Schema):
    found = [Best(k) for _ in queries.items]
    held: list[pa.RecordBatch] = []

    def run():
        block = pa.Table.from_batches(held)
        held.clear()
        listed = block.column("terms").combine_chunks()
        size = np.asarray(listed.value_lengths(), np.int64)
        ids = block.column("doc_id").to_numpy() if not block.column("doc_id").null_count else np.array(
            [_NO_ID if i is None else i for i in block.column("doc_id").to_pylist()], np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        term = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        count = block.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = block.column("n").to_numpy()
        lists = ImpactLists(doc, term, corpus.impacts(term, count, n[doc]), len(queries.vocabulary))
        for wanted, best in zip(queries.wanted, found, strict=True):
            best_positions(lists, wanted, ids, best)

    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(batch.schema.get_field_index("terms")).flatten())
        if size >= block_postings:
            run()
            size = 0
    if held:
        run()
    for q, best in enumerate(found):
        if len(best.doc):
            yield record_batch(schema, [[q] * len(best.doc), [None if d == _NO_ID else int(d) for d in best.doc], best.score])


def search(docs: DataFrame, items: DataFrame, k: int = 20, query_bytes: int = QUERY_BYTES,
           block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each
    item, all of them if fewer score above 0.

    Null, empty and wordless texts have no terms: such documents are not found
    and not counted, such items find nothing.  Every document row is a document
    of its own (repeated rows are found and counted each, a null id comes last
    among equal scores); equal rows of ``items`` are one item, different texts
    under one id are ranked separately.  Other columns are ignored; empty tables
    give no rows.  The items are read to the driver in parts of about
    ``query_bytes``, one pass over the documents each.
    """
    docs = shipped(docs)
    items = stage(items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct(),
                  "search-items")
    passes = max(1, math.ceil(measured(items)[1] / query_bytes))
    schema = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    out = None
    for i in range(passes):
        queries = Queries.of(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect())
        posted = stage(postings(docs, queries.vocabulary), "search-postings")
        corpus = Corpus.of(posted, len(queries.vocabulary))
        hits = posted.where(F.size("terms") > 0).mapInArrow(
            partial(_search, queries=queries, corpus=corpus, k=k, block_postings=block_postings, schema=schema),
            "q long, doc_id long, score long")
        best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        names = docs.sparkSession.createDataFrame(list(enumerate(queries.items)), "q long, item_id long")
        ranked = (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                  .join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))   # a pass's items, bounded
        out = ranked if out is None else out.unionByName(ranked)
    return out
