"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct word shingles.  Equal sets form a class; from
then on only classes are worked on.  Each class has a signature of
``COORDINATES`` MinHash values and is posted under (coordinate, value) pairs.
Two classes that agree in ``MATCHES`` coordinates share one of any
COORDINATES - MATCHES + 1 pairs of each, so only that many, the rarest, are
posted (prefix), and the frequent rest is skipped and met again only when a
candidate's collisions are counted on the signatures.  Candidates above the
match threshold are confirmed on the full shingle sets.

Candidates are met in two rounds.  First each class meets one class only, the
smallest id of a posting list it shares most collisions with.  What is linked
then is one component, and the second round meets all remaining pairs across
components: as rows for short posting lists, in blocks of signatures for long
ones, from which only links leave.  So a group of thousands of near copies is
joined without writing out its pairs.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemscore.llm.common import SLICE_CHARS, pylists, record_batch, shipped, sliced, small, stage

SHINGLE_WORDS = 5
#: Percent of the union that the intersection must reach.
PERCENT = 75
#: At similarity 0.75 the agreeing coordinates of 64 are 48 +- 3.5: fewer than
#: 32 come about once in a few hundred thousand links, fewer above.
COORDINATES = 64
MATCHES = 32
#: Posting lists longer than this meet in blocks of signatures, not as rows.
LIST_ROWS = 48
BLOCK_ROWS = 256
_M = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased: runs without white space (x20, x09-x0D)."""
    return text.encode().lower().split()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Signer:
    """Shingle hashes, class keys and MinHash signatures of texts."""

    def __init__(self, n: int = SHINGLE_WORDS, coordinates: int = COORDINATES):
        self.n, self.hashes = n, _WordHashes()
        seeds = np.arange(1, 3 * coordinates + 1, dtype=np.uint64)
        self.a = _mix(seeds[:coordinates] * _M) | np.uint64(1)
        self.b = _mix(seeds[coordinates:2 * coordinates] * _M)
        self.own = _mix(seeds[2 * coordinates:] * _M)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes."""
        w = words(text)
        h = np.fromiter(map(self.hashes.__getitem__, w), dtype=np.uint64, count=len(w))
        if not len(h):
            return h
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out = out * _M + h[i:len(h) - n + 1 + i]
        return np.unique(_mix(out))

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        """Per coordinate the least 64-bit linear hash of all shingles, mixed with
        the coordinate: equal values mean the same coordinate and value."""
        low = np.full(len(self.a), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for k in range(0, len(shingles), 2048):
            low = np.minimum(low, (shingles[k:k + 2048, None] * self.a + self.b).min(axis=0))
        return _mix(low ^ self.own).view(np.int64)


def signatures(docs: DataFrame, n: int = SHINGLE_WORDS, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, text_key (a hash), n_shingles, cls (128-bit key of the set, null if it is empty), signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()),
                        ("signature", pa.list_(pa.int64()))])

    def run(batches):
        signer = Signer(n, coordinates)
        for batch in sliced(batches, "text"):
            ids, keys, texts = pylists(batch, "doc_id", "text_key", "text")
            sets = [signer.shingles(t or "") for t in texts]
            yield record_batch(schema, (
                ids, keys, [len(s) for s in sets],
                [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                [signer.sign(s) if len(s) else None for s in sets]))

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, cls binary, signature array<long>")


def prefix_postings(nodes: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(rep, key) under each class's rarest coordinate values that others hold too."""
    every = nodes.select("rep", F.explode("signature").alias("key"))
    shared = stage(every.groupBy("key").count().where("count > 1"), "minhash-counts")
    # Values of one class only are its rarest, so they use up places of its prefix first.
    place = F.lit(coordinates - matches + 1) - (F.lit(coordinates) - F.size("keys"))
    kept = (every.join(shared, "key").groupBy("rep").agg(F.collect_list(F.struct("count", "key")).alias("keys"))
            .select("rep", place.alias("place"), F.sort_array("keys").alias("keys")).where("place > 0"))
    return stage(kept.select("rep", F.explode(F.slice("keys", 1, F.col("place"))).alias("k"))
                 .select("rep", F.col("k.key").alias("key")), "minhash-postings")


def _collisions(pairs: DataFrame, nodes: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough and whose sizes allow a link."""
    side = lambda c: small(nodes, 50_000).select(F.col("rep").alias(c), F.col("signature").alias(f"s{c}"),
                                                 F.col("n_shingles").alias(f"n{c}"))
    equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where((equal >= matches) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
            .select("a", "b"))


def shingle_sets(docs: DataFrame, ids: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """(rep, shingles: the sorted 64-bit hashes of all shingles, 8 bytes each) of
    the documents with these ids, staged."""
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        signer = Signer(n, 1)
        for batch in sliced(batches, "text"):
            keys, texts = pylists(batch, "doc_id", "text")
            yield record_batch(schema, (keys, [signer.shingles(t or "").tobytes() for t in texts]))

    return stage(docs.join(small(ids.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").select("doc_id", "text")
                 .mapInArrow(run, "rep long, shingles binary"), "minhash-sets")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets overlap enough."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)


def confirm(pairs: DataFrame, docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Of the staged pairs (a, b) of doc_ids those linked on their full shingle
    sets.  The sets are compared as 64-bit hashes: two different shingles of a
    pair look equal once in about 10^13 pairs of thousand-word texts."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "minhash-needed")
    sets = shingle_sets(docs, ids, n)
    both = (pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a"))

    def run(batches):
        for batch in sliced(batches, "sa", "sb", size=16 * SLICE_CHARS):
            keep = [_linked(np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64), percent)
                    for sa, sb in zip(*pylists(batch, "sa", "sb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct(), "minhash-links")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the links (a, b).

    Each step takes the smallest label next door and then the label's label,
    so chains shorten by halves; labels are staged between the steps.
    """
    edges = stage(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                               .alias("e")).select("e.a", "e.b").distinct(), "component-edges")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")),
                   "component-labels")
    while True:
        of = small(labels).select(F.col("node").alias("b"), F.col("component").alias("near"))
        least = edges.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = stage(labels.join(least, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component")), "component-hooked")
        jump = small(hooked).select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = stage(hooked.join(jump, "component").select("node", "was", F.col("further").alias("component")),
                    "component-labels")
        if not new.where("was <> component").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _across(post: DataFrame, labels: DataFrame, long_rows: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """What may still link different components: pairs (a, b) that share a short
    posting list, and for long lists their members in groups (rep, component,
    grp), where lists with a common member are one group (null if none is long)."""
    long_rows = long_rows or LIST_ROWS
    named = stage(post.join(small(labels).select(F.col("node").alias("rep"), "component"), "rep", "left")
                  .select("key", "rep", F.coalesce("component", "rep").alias("component")), "minhash-named")
    lists = (named.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("hub"),
                                      F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low < high").select("key", "size", "hub"))
    rows = stage(named.join(small(stage(lists, "minhash-lists")), "key"), "minhash-mixed")
    long = rows.where(F.col("size") > long_rows)
    groups = None
    if long.limit(1).count():
        of = components(long.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
        of = stage(of.select(F.col("node").alias("rep"), F.col("component").alias("grp")), "minhash-groups")
        groups = stage(long.select("rep", "component").distinct().join(small(of), "rep"), "minhash-grouped")
        short = rows.where(F.col("size") <= long_rows).join(small(of), "rep", "left")
    else:
        short = rows.withColumn("grp", F.lit(None).cast("long"))
    side = lambda c: short.select("key", F.col("rep").alias(c), F.col("component").alias(f"c{c}"),
                                  F.col("grp").alias(f"g{c}"))
    pairs = side("a").join(side("b"), "key").where(
        (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ~F.coalesce(F.col("ga") == F.col("gb"), F.lit(False)))
    return stage(pairs.select("a", "b").distinct(), "minhash-across"), groups


def _meet_groups(groups: DataFrame, nodes: DataFrame, docs: DataFrame, matches: int, n: int, percent: int) -> DataFrame:
    """Links (a, b) inside groups of long lists: members outside the group's
    largest component against all members, in blocks of at most about
    BLOCK_ROWS by BLOCK_ROWS rows.  Signatures are compared first; pairs above
    the match threshold are confirmed on the shingle sets, those with most
    collisions first, until a member has a link to each other component of the
    block.  Only links leave a block."""
    sizes = groups.groupBy("grp", "component").agg(F.count("*").alias("n"))
    sizes = stage(sizes.groupBy("grp").agg(F.sum("n").alias("size"), F.max("n").alias("most"),
                                           F.max_by("component", F.struct("n", "component")).alias("main"))
                  .where("size > most"), "minhash-group-sizes")
    rows = groups.join(small(sizes), "grp")
    sets = shingle_sets(docs, stage(rows.select("rep").distinct(), "minhash-group-ids"), n)
    rows = stage(rows.join(nodes.select("rep", "signature"), "rep").join(sets, "rep"), "minhash-group-rows")
    n_left = F.ceil((F.col("size") - F.col("most")) / BLOCK_ROWS).cast("int")
    n_right = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    spot = F.xxhash64("rep")
    left = (rows.where("component <> main").withColumn("i", F.pmod(spot, n_left).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), n_right - 1))).withColumn("side", F.lit(0)))
    right = (rows.withColumn("j", F.pmod(spot, n_right).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), n_left - 1))).withColumn("side", F.lit(1)))
    columns = ["grp", "i", "j", "side", "rep", "component", "signature", "shingles"]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        l, r = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = []
        if not l.empty and not r.empty:
            signs, rep, comp = np.stack(r["signature"].to_list()), r["rep"].to_numpy(), r["component"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in r["shingles"]]
            for one, c, s, mine in zip(l["rep"], l["component"], l["signature"], l["shingles"], strict=True):
                equal = (signs == np.asarray(s)).sum(axis=1)
                near = np.flatnonzero((equal >= matches) & (comp != c))
                if not len(near):
                    continue
                mine, linked = np.frombuffer(mine, np.uint64), set()
                for k in near[np.argsort(-equal[near], kind="stable")]:
                    if comp[k] not in linked and _linked(mine, sets[k], percent):
                        linked.add(comp[k])
                        out.append((min(one, rep[k]), max(one, rep[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    # Dealt over an explicit number of partitions: a block is few bytes but much work, and must not be merged by bytes.
    deal = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(left.select(columns).unionByName(right.select(columns)).repartition(deal, "grp", "i", "j").groupBy("grp", "i", "j")
                 .applyInPandas(meet, "a long, b long").distinct(), "minhash-links")


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT,
                    coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable over links), kept (doc_id = component_id), class_id (the
    smallest doc_id with the same set; null for an empty set), text_key
    (xxhash64 of the text, which tells rows with one id apart).

    Null, empty and blank texts have empty sets: they are linked with nothing
    and kept.  Rows without an id take no part: their component is null and
    they are kept.  Rows with equal texts are one class; repeated rows each get
    a row (kept, if their id is the component's).  Other columns are ignored;
    an empty table gives no rows.
    """
    docs = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = stage(signatures(docs, n, coordinates), "minhash-signatures")
    nodes = stage(base.where("cls is not null and doc_id is not null").groupBy("cls")
                  .agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("m"))
                  .select("cls", F.col("m.doc_id").alias("rep"), "m.n_shingles", "m.signature"), "minhash-classes")
    post = prefix_postings(nodes, coordinates, matches)

    hubs = stage(post.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
                 .select("key", "a"), "minhash-hubs")
    met = post.select("key", F.col("rep").alias("b")).join(hubs, "key").where("a <> b")
    stars = (met.groupBy("a", "b").count().groupBy("b")
             .agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b"))
    first = confirm(stage(_collisions(stage(stars, "minhash-stars"), nodes, matches, percent), "minhash-pairs"),
                    docs, n, percent)
    labels = components(first)
    pairs, groups = _across(post, labels)
    rest = stage(_collisions(pairs, nodes, matches, percent), "minhash-pairs")
    links = first
    if rest.limit(1).count():
        links = links.unionByName(confirm(rest, docs, n, percent))
    if groups is not None:
        links = links.unionByName(_meet_groups(groups, nodes, docs, matches, n, percent))
    if links is not first:
        labels = components(links)

    classes = stage(nodes.select("cls", "rep").join(small(labels).select(F.col("node").alias("rep"), "component"),
                                                    "rep", "left")
                    .select(F.col("cls").alias("of"), F.col("rep").alias("class_id"),
                            F.coalesce("component", "rep").alias("component")), "minhash-components")
    out = (base.select("doc_id", "text_key", "n_shingles", "cls")
           .join(small(classes), F.col("cls") == F.col("of"), "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "class_id", "text_key")
