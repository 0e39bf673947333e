"""Benchmark decontamination by winnowing.

Of every window of ``span`` words the k-gram with the smallest hash is the
window's fingerprint (leftmost among equals), in documents and items alike.  A
shared window has the same fingerprint at the same place on both sides, so the
join on fingerprints meets every shared window; each meeting is then extended
word by word to both sides, and counts if ``span`` words stand together.  All
of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemscore.llm.common import ascii_lower, small, stage

SPAN = 10
GRAM = 6
#: Words of a document that are fingerprinted together (long texts are cut into
#: blocks that overlap by a window, so no row outgrows memory and no window is lost).
BLOCK = 4096
_PLACE_BITS = 16


def words(text: Column) -> Column:
    """Words after lower-casing A-Z: runs of a-z, 0-9 and non-ASCII characters."""
    found = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(found, "")


def _blocks(df: DataFrame, block: int, span: int) -> DataFrame:
    """Adds ``first`` (words before the block) and cuts ``words`` to the block."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(block))
    return (df.withColumn("first", F.explode(starts))
            .withColumn("words", F.slice("words", F.col("first") + 1, block + span - 1)))


def fingerprints(df: DataFrame, gram: int, span: int, block: int = BLOCK) -> DataFrame:
    """Rows (keys, gram hash, place in the text, words around it) of all
    windows' fingerprints; ``df`` has ``words`` and other key columns.

    ``around`` holds the gram with up to span - gram words before (``lead`` of
    them) and after it.
    """
    keys = [c for c in df.columns if c != "words"]
    side, window = span - gram, span - gram + 1
    df = _blocks(df, block, span).where(F.size("words") >= span)
    if window == 1:
        marks = F.transform(
            F.sequence(F.lit(0), F.size("words") - gram),
            lambda i: F.shiftleft(F.xxhash64(F.slice("words", i + 1, gram)), _PLACE_BITS).bitwiseOR(i.cast("long")))
        df = df.withColumn("chosen", marks)
    else:
        marks = F.transform(
            F.sequence(F.lit(0), F.size("words") - gram),
            lambda i: F.shiftleft(F.xxhash64(F.slice("words", i + 1, gram)), _PLACE_BITS).bitwiseOR(i.cast("long")))
        df = df.withColumn("marks", marks)
        df = df.withColumn("chosen", F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size("marks") - window + 1), lambda i: F.array_min(F.slice("marks", i, window)))))
    place = lambda v: v.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
    found = F.transform("chosen", lambda v: F.struct(
        F.shiftright(v, _PLACE_BITS).alias("gram"), place(v).alias("at"),
        F.least(place(v), F.lit(side)).alias("lead"),
        F.slice("words", F.greatest(place(v) - side, F.lit(0)) + 1,
                F.least(place(v), F.lit(side)) + gram + side).alias("around")))
    return (df.select(*keys, "first", F.inline(found))
            .withColumn("at", F.col("at") + F.col("first")).drop("first"))


def _run(a: Column, a_lead: Column, b: Column, b_lead: Column, side: int, offset: int, step: int) -> Column:
    """How many words, from ``offset`` after the gram's start in steps of
    ``step``, are equal one after the other (0 to ``side``)."""
    total, going = F.lit(0), F.lit(True)
    for i in range(side):
        pa, pb = a_lead + offset + step * i, b_lead + offset + step * i
        same = F.coalesce((pa >= 0) & (pb >= 0) & (F.get(a, pa) == F.get(b, pb)), F.lit(False))
        going = going & same
        total = total + going.cast("int")
    return total


def _hits(docs: DataFrame, items: DataFrame, gram: int, span: int, block: int) -> DataFrame:
    """(document keys, start, end, item ids) of extended meetings of span words or more."""
    side = span - gram
    marks = (fingerprints(items, gram, span, block).drop("at")
             .groupBy("gram", "lead", "around").agg(F.collect_set("item_id").alias("item_ids")))
    marks = stage(marks.select("gram", F.col("lead").alias("i_lead"), F.col("around").alias("i_around"), "item_ids"),
                  "winnow-items")
    met = fingerprints(docs, gram, span, block).join(small(marks), "gram")
    d, dl, i, il = (F.col(c) for c in ("around", "lead", "i_around", "i_lead"))
    met = met.where(F.slice(d, dl + 1, gram) == F.slice(i, il + 1, gram))
    met = met.withColumn("left", _run(d, dl, i, il, side, -1, -1)).withColumn("right", _run(d, dl, i, il, side, gram, 1))
    return (met.where(F.col("left") + F.col("right") + gram >= span)
            .select(*[c for c in docs.columns if c != "words"], (F.col("at") - F.col("left")).alias("start"),
                    (F.col("at") + gram + F.col("right")).alias("end"), "item_ids"))


def find_hits(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(key columns of docs, start, end, item_ids) of every place where
    ``span`` words of an item, or a whole shorter item, stand in a document.

    ``docs`` has a ``words`` array and key columns, ``items`` item_id and words.
    """
    items = stage(items.where(F.size("words") > 0), "winnow-benchmark")
    out = _hits(docs, items.where(F.size("words") >= span), gram, span, block)
    short = sorted(r[0] for r in items.where(F.size("words") < span).select(F.size("words")).distinct().collect())
    for n in short:                                            # at most span - 1 lengths
        out = out.unionByName(_hits(docs, items.where(F.size("words") == n), n, n, block))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit (words inside any
    occurrence of an item's window), n_items, items_sha256 (of the item ids,
    sorted as strings, comma-joined), contaminated.

    Null and empty texts have no words and no hits; items without words have
    no windows; a null item_id marks its hits but is not counted or listed.
    Repeated rows get a row each; null doc_ids stay; other columns are ignored;
    an empty benchmark hits nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text_key = F.xxhash64("text").alias("text_key")
    items = benchmark.select("item_id", words(F.col("text")).alias("words"))
    base = docs.select("doc_id", text_key, words(F.col("text")).alias("words"))
    hits = stage(find_hits(base, items, span, gram, block), "winnow-hits")
    per_doc = (hits.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("ids"))
        .select("doc_id", "text_key",
                F.size(F.array_distinct(F.flatten(F.transform(
                    "spans", lambda s: F.sequence(s["start"], s["end"] - 1))))).cast("long").alias("n_hit"),
                F.sort_array(F.col("ids").cast("array<string>")).alias("ids")))
    per_doc = stage(per_doc.select("doc_id", "text_key", "n_hit", F.size("ids").cast("long").alias("n_items"),
                                   F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "winnow-documents")
    counted = base.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
    p, d = small(per_doc).alias("p"), counted.alias("d")
    none = F.sha2(F.lit(""), 256)
    return d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key")),
                  "left").select(
        "d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
