"""Gestalt (Ratcliff-Obershelp) similarity as Arrow-batched pandas UDFs.

Spark has no built-in for this measure (``levenshtein`` is a different one),
so it is the one place where Python runs per value.  Callers apply it to
*distinct* names only, never to every claim.

Argument order matters: the measure is not symmetric.  As in
``difflib.get_close_matches`` the candidate key is ``seq1`` and the word is
``seq2``.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chemscore._ship import ship_by_value

ship_by_value(__name__)

MATCH_TYPE = T.StructType([T.StructField("key", T.StringType()),
                           T.StructField("ratio", T.DoubleType())])


@F.pandas_udf(T.DoubleType())
def ratio_udf(seq1: pd.Series, seq2: pd.Series) -> pd.Series:
    """``SequenceMatcher(None, seq1, seq2).ratio()``; NULL in, NULL out."""
    sm = difflib.SequenceMatcher(None)
    out = []
    for a, b in zip(seq1, seq2):
        if a is None or b is None:
            out.append(None)
            continue
        sm.set_seqs(a, b)
        out.append(sm.ratio())
    return pd.Series(out, dtype="float64")


def best_match(word: str, candidates: Sequence[str], cutoff: float) -> tuple[str | None, float | None]:
    """Top-1 of ``get_close_matches(word, candidates, n=1, cutoff)`` plus its ratio.

    Same filter chain (real_quick_ratio, quick_ratio, ratio >= cutoff) and the
    same tie rule: highest ratio, then greatest key.
    """
    sm = difflib.SequenceMatcher()
    sm.set_seq2(word)
    best: tuple[float, str] | None = None
    for x in candidates:
        sm.set_seq1(x)
        if sm.real_quick_ratio() >= cutoff and sm.quick_ratio() >= cutoff:
            r = sm.ratio()
            if r >= cutoff and (best is None or (r, x) > best):
                best = (r, x)
    return (None, None) if best is None else (best[1], best[0])


def closest_match_udf(candidates: Sequence[str], cutoff: float = 0.1):
    """A scalar pandas UDF ``word -> STRUCT<key, ratio>`` over a fixed,
    small candidate list (shipped in the closure; at most a few hundred keys)."""
    cands = tuple(dict.fromkeys(candidates))

    @F.pandas_udf(MATCH_TYPE)
    def _closest(words: pd.Series) -> pd.DataFrame:
        keys, ratios = [], []
        for w in words:
            if w is None:
                k, r = None, None
            else:
                k, r = best_match(w, cands, cutoff)
            keys.append(k)
            ratios.append(r)
        return pd.DataFrame({"key": keys, "ratio": pd.Series(ratios, dtype="float64")})

    # Declared non-deterministic so the optimizer never copies the call below
    # a ``distinct`` (a filter on its result would otherwise be pushed down and
    # the UDF would run once per claim instead of once per distinct name).
    return _closest.asNondeterministic()


def closest_matches_udf(candidate_sets: dict[str, Sequence[str]], cutoff: float = 0.1):
    """Several J5 look-ups in one Arrow pass.

    ``word -> STRUCT<{name}_key STRING, {name}_ratio DOUBLE, ...>`` with one
    key/ratio pair per named candidate list (flat: Arrow UDFs return flat structs).
    """
    sets = {name: tuple(dict.fromkeys(c)) for name, c in candidate_sets.items()}
    fields = []
    for name in sets:
        fields += [T.StructField(f"{name}_key", T.StringType()), T.StructField(f"{name}_ratio", T.DoubleType())]

    @F.pandas_udf(T.StructType(fields))
    def _closest_many(words: pd.Series) -> pd.DataFrame:
        out = {}
        for name, cands in sets.items():
            ks, rs = [], []
            for w in words:
                k, r = (None, None) if w is None else best_match(w, cands, cutoff)
                ks.append(k)
                rs.append(r)
            out[f"{name}_key"] = pd.Series(ks, dtype="object")
            out[f"{name}_ratio"] = pd.Series(rs, dtype="float64")
        return pd.DataFrame(out)

    return _closest_many.asNondeterministic()  # see closest_match_udf
