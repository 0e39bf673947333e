"""Join helpers: broadcast only behind a size check, salted shuffle beyond it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chemscore.session import materialize

# Rows and bytes that a lookup side may have before we stop broadcasting it.
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20
HOT_KEY_SALTS = 32


def _width(field: T.StructField) -> Column:
    """Bytes that a value of this column takes, as an upper guide."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.DateType, T.TimestampType)):
        size = 8 * F.size(c)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(F.struct(c)))
    else:
        size = F.lit(0)
    return 16 + F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a staged table, in one pass over it."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        size = size + _width(field)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return row["n"], row["b"] or 0


def lookup_join(big: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner",
                max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                salts: int = 0, salt_by: Sequence[str] | None = None, stage: bool = True) -> DataFrame:
    """N:1 join of a large table to a lookup table whose size is data dependent.

    The lookup side is staged once (``stage``; callers holding an already
    written table pass ``stage=False``), so that measuring it and the join do
    not recompute it; when it fits under ``max_broadcast_rows`` and
    ``DEFAULT_BROADCAST_BYTES`` it is broadcast and the large side is not
    shuffled at all.  Beyond that:

    * ``salts > 1`` (callers that know some keys are hot, e.g. a few claimed
      property names carry most claims): a shuffle join on salted keys.  Each
      large-side row gets one of ``salts`` sub-keys and the lookup side is
      replicated ``salts`` times, so a hot key (say a third of all rows) is
      spread over ``salts`` tasks.  The salt is a hash of ``salt_by``
      (default: all large-side columns), so a retried task routes every row
      exactly as before.
    * otherwise a plain shuffle join; AQE's skew-join rule still splits a
      partition that turns out to be hot at run time, without replicating the
      whole lookup side up front.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join supports inner/left/semi/anti, not {how!r}")
    if stage:
        dim = materialize(dim, "lookup")
    rows, size = measured(dim)
    if rows <= max_broadcast_rows and size <= DEFAULT_BROADCAST_BYTES:
        return big.join(F.broadcast(dim), list(on), how)
    if salts <= 1:
        return big.join(dim, list(on), how)
    salt = "_salt"
    big_s = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in (salt_by or big.columns)]), F.lit(salts)))
    dim_s = dim.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return big_s.join(dim_s, [*on, salt], how).drop(salt)
