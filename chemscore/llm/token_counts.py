"""Token counts by a map-side two-tier lookup.

Tier 1 is a compact hash table of the token counts of frequent pre-token runs
(a space and what follows up to the next space), broadcast to all workers.
Tier 2 is each worker's bounded cache; its misses go to the tokenizers library
in batches.  No pre-token is ever shuffled: a document's count is a sum within
its task.  Both tiers hold exact counts, so the table's choice changes the
speed and never a result.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemscore.llm.bytebpe import KEEP_CHARS, CachedCoder, LibraryCodes, PreTokens, library
from chemscore.llm.common import hash_share, pylists, record_batch, shipped, text_slices

#: The frequent table is fitted on about this many rows, chosen by a hash of doc_id and text.
SAMPLE_ROWS = 2_000
#: Entries of the frequent table (bound of what is broadcast).
TABLE_ROWS = 32_768


def frequent_runs(docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS,
                  table_rows: int = TABLE_ROWS) -> dict[str, int]:
    """Token counts of the most frequent space-led runs of a bounded sample of rows."""
    n = docs.count()
    share = min(1.0, sample_rows / max(n, 1))
    # chosen by id and text, and equal rows once: no hot id fills the sample
    sample = docs.where(hash_share(F.xxhash64("doc_id", "text"), share)).dropDuplicates(["doc_id", "text"])
    schema = pa.schema([("run", pa.string()), ("n", pa.int64()), ("tokens", pa.int64())])

    def top(batches):
        pre, seen = PreTokens(path), Counter()
        for batch in batches:
            for text in pylists(batch, "text")[0]:
                for segment in pre.segments(text or "")[::2]:
                    seen.update(r for r in pre.runs(segment)[1] if len(r) <= KEEP_CHARS)
            if len(seen) > 20 * table_rows:
                seen = Counter(dict(seen.most_common(10 * table_rows)))
        runs = seen.most_common(table_rows)
        coded = library(path).encode_batch_fast([" " + r for r, _ in runs], add_special_tokens=False)
        yield record_batch(schema, ([r for r, _ in runs], [k for _, k in runs], [len(e.ids) for e in coded]))

    # all tasks scan and choose; only the chosen rows (about sample_rows) meet in one
    found = sample.select("text").repartition(1).mapInArrow(top, "run string, n long, tokens long")
    return {r.run: r.tokens for r in found.orderBy(F.desc("n"), "run").limit(table_rows).collect()}


_coders: dict[tuple[str, str], CachedCoder] = {}


def _worker(path: str, name: str, table) -> CachedCoder:
    """The worker's coder for one broadcast table; the one before it goes."""
    if (path, name) not in _coders:
        _coders.clear()
        codes = LibraryCodes(path, len, sum)
        _coders[path, name] = CachedCoder(codes.pre, codes.code, lambda _: 1, sum, frequent=table.value)
    return _coders[path, name]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, sample_rows: int = SAMPLE_ROWS,
                 table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Null texts are empty: 0 bytes, 0 tokens.  Repeated rows each get their own
    row; null ids stay; other columns are ignored; an empty table gives none.
    """
    docs = shipped(docs).select("doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_runs(docs, path, sample_rows, table_rows))
    name = uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_())])

    def count(batches):
        coder = _worker(path, name, table)
        for batch in batches:
            ids, texts = pylists(batch, "doc_id", "text")
            for start, part in text_slices(texts):
                n = coder.texts(part)
                yield record_batch(schema, (ids[start:start + len(part)], [len(t.encode()) for t in part], n,
                                            [k > limit for k in n]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
