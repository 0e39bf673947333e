"""BPE encoding by segment trees over adjacent pair ranks, and decoding.

Each pre-token is a row of byte ids with a segment tree whose leaf i holds
(rank of the pair that starts at i, i).  The root is the leftmost pair of
lowest rank.  A merge changes three leaves (the merged pair, the pair before,
the pair that went), each a point update of log2(size) nodes; rows are done
when their root holds no rank.  Trees of one size are worked on together as
numpy rows, so a batch costs a few array steps per merge round.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemscore.llm.bytebpe import KEEP_CHARS, CachedCoder, PreTokens, byte_alphabet
from chemscore.llm.common import pylists, record_batch, release, shipped, sliced

_NONE = np.int64(1) << 62
#: Tree cells worked on together (bounds a worker's memory).
_CELLS = 1 << 18
#: Pre-tokens whose ids a worker keeps.
_KNOWN = 150_000


class TreeBPE:
    """Encoder and decoder for one byte-level BPE file."""

    def __init__(self, path: str):
        self.pre = PreTokens(path)
        vocab = dict(self.pre.file["model"]["vocab"])
        merges = [m if isinstance(m, list) else m.split(" ") for m in self.pre.file["model"]["merges"]]
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.width = max([*vocab.values(), *self.pre.added.values()]) + 1
        pairs = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        to_byte = {c: b for b, c in enumerate(alphabet)}
        self.token_bytes = [b""] * self.width
        for token, i in [*vocab.items(), *self.pre.added.items()]:
            known = all(c in to_byte for c in token)
            self.token_bytes[i] = bytes(to_byte[c] for c in token) if known else token.encode()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def _merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids (little-endian uint32) of pieces of at most ``size`` bytes, size a power of two."""
        m, bits = len(pieces), max(1, size.bit_length() - 1)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(m, size)
        column = np.arange(size)
        ids = np.where(column < lengths[:, None], self.byte_id[raw], -1)
        after = np.where(column + 1 < lengths[:, None], column + 1, size)      # size: none
        before = np.broadcast_to(column - 1, (m, size)).copy()                 # -1: none
        tree = np.full((m, 2 * size), _NONE)
        if size > 1:
            r = self._rank(ids[:, :-1], ids[:, 1:])
            tree[:, size:-1] = np.where(r >= 0, (r << 32) | column[:-1], _NONE)
        level = size
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2

        def put(rows, at, key):
            node = at + size
            tree[rows, node] = key
            for _ in range(bits):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair_key(rows, left, right):
            r = self._rank(ids[rows, left], ids[rows, right])
            return np.where(r >= 0, (r << 32) | left, _NONE)

        rows = np.arange(m) if size > 1 else np.arange(0)
        while len(rows := rows[tree[rows, 1] < _NONE]):
            root = tree[rows, 1]
            at, gone = root & 0xFFFFFFFF, after[rows, root & 0xFFFFFFFF]
            ids[rows, at] = self.made[root >> 32]
            ids[rows, gone] = -1
            following = after[rows, gone]
            after[rows, at] = following
            put(rows, gone, _NONE)
            has = following < size
            put(rows[~has], at[~has], _NONE)
            r, a, f = rows[has], at[has], following[has]
            before[r, f] = a
            put(r, a, pair_key(r, a, f))
            has = before[rows, at] >= 0
            r, a = rows[has], at[has]
            b = before[r, a]
            put(r, b, pair_key(r, b, a))
        live = ids >= 0
        flat, ends = ids[live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def pre_tokens(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each non-empty pre-token."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for size, members in by_size.items():
            step = max(1, _CELLS // size)
            for k in range(0, len(members), step):
                part = members[k:k + step]
                for i, code in zip(part, self._merge([pieces[i] for i in part], size), strict=True):
                    out[i] = code
        return out

    def code(self, runs: list[str], lead: str) -> list[bytes]:
        """Ids of each run after ``lead``: its pre-tokens' ids in a row."""
        cut = [self.pre.pieces(r, lead) for r in runs]
        if len(self.known) > _KNOWN:
            self.known = {}
        new = {p for pieces in cut for p in pieces}.difference(self.known)
        distinct = list(new)
        known = self.known
        known.update(zip(distinct, self.pre_tokens([p.encode() for p in distinct]), strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for p in distinct:
            if len(p) > KEEP_CHARS:
                del known[p]
        return out

    def coder(self, limit: int = 150_000) -> CachedCoder:
        return CachedCoder(self.pre, self.code, lambda i: i.to_bytes(4, "little"), b"".join, limit)

    def decode(self, ids: bytes) -> str:
        """The text of little-endian uint32 ids, special tokens included."""
        at = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, at)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _worker(path: str, limit: int = 150_000) -> tuple[TreeBPE, CachedCoder]:
    tree = TreeBPE(path)
    return tree, tree.coder(limit)


#: Codes of a generation that a worker of ``encode`` keeps while its task runs.
_ENCODE_CODES = 75_000


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian uint32 binary) of every whole text.

    Null texts are empty (no ids).  Strings of added tokens become their ids,
    as the tokenizers library does by default.  Repeated rows and null ids
    stay; other columns are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        tree, coder = _worker(path, _ENCODE_CODES)
        for batch in sliced(batches, "text"):
            keys, texts = pylists(batch, "doc_id", "text")
            yield record_batch(schema, (keys, coder.texts([t or "" for t in texts])))
        # the worker lives on beside the stages that follow: it keeps no texts' codes
        tree.known = {}
        coder.forget()
        release()

    return shipped(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids binary); null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        tree, _ = _worker(path)
        for batch in batches:
            keys, ids = pylists(batch, "doc_id", "ids")
            yield record_batch(schema, (keys, [tree.decode(x or b"") for x in ids]))

    return shipped(tokens).select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the text decoded
    from the ids): encode and decode in one pass, with the same defined cases."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def run(batches):
        tree, coder = _worker(path)
        for batch in sliced(batches, "text"):
            keys, texts = pylists(batch, "doc_id", "text")
            ids = coder.texts([t or "" for t in texts])
            yield record_batch(schema, (
                keys, [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(tree.decode(x).encode()).hexdigest() for x in ids]))

    return shipped(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
