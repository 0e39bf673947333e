"""Secret scans by a trigram inverted index.

Every rule is a regular expression.  From its parse tree a Boolean query is
derived: one set of trigrams for each way through the expression's literals,
of which one set must be wholly in a text for the rule to match.  The index
posts documents under the trigrams the queries ask for; postings are
intersected, and only the rules whose query a document meets are run on it.
Rules without a mandatory trigram scan every text.  The scan of documents is
all DataFrame expressions; only the rules are parsed in Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as _c
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemscore.llm.common import ascii_lower, small, stage


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of a group of it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    base: bool = False


#: The base rules.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
         True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, False, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, False, True),
)
#: Further rules of this method.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
#: Ways through an expression that are told apart; beyond it the rule scans fully.
_WAYS = 512


def _ways(tree, ways: list[tuple[tuple[str, ...], str]]):
    """All ways through a parse tree: (literal runs that ended, the open run)."""
    for op, arg in tree:
        if op is _c.LITERAL:
            ways = [(done, run + chr(arg)) for done, run in ways]
        elif op is _c.SUBPATTERN:
            ways = _ways(arg[3], ways)
        elif op is _c.BRANCH:
            ways = [w for branch in arg[1] for w in _ways(branch, ways)]
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
            ways = ways + _ways(arg[2], ways)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
            once = _ways(arg[2], ways)
            ways = once if arg[1] == 1 else [((*done, run), "") for done, run in once]
        elif op is _c.IN and len(arg) <= 4 and all(a[0] is _c.LITERAL for a in arg):
            ways = [(done, run + chr(a[1])) for a in arg for done, run in ways]
        elif op is not _c.AT:                                  # any other part ends the literal runs
            ways = [((*done, run), "") for done, run in ways]
        ways = list(dict.fromkeys(ways))
        if len(ways) > _WAYS:
            return [((), "")]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams, one of which is wholly in every text that
    matches; empty if the expression has no mandatory trigram."""
    sets = set()
    for done, run in _ways(_parser.parse(pattern), [((), "")]):
        sets.add(frozenset(r[i:i + 3].lower() for r in (*done, run) for i in range(len(r) - 2)))
    if frozenset() in sets or any(not t.isascii() for s in sets for t in s):
        return []
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's matches, in code points."""
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, pattern, -1)                          # one more than the matches
    sizes = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(found)), found,
                                  lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
                       held, lambda s, h: F.struct(s["gap"].alias("gap"), s["size"].alias("size"),
                                                   F.length(h).alias("held")))
    span = "struct<start:int,rank:int,end:int,kind:string>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def add(acc, s):
        begin = acc["at"] + s["gap"]
        one = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + s["size"]).alias("end"),
                               F.lit(rule.kind).alias("kind")))
        return F.struct((begin + s["size"]).alias("at"),
                        F.when(s["held"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(sizes, zero, add, lambda acc: acc["out"])
    # Most texts that get here hold no match that is long enough: ask that first.
    # (A run of one class has a long match exactly if it has one of the least length.)
    whole = not rule.group and rule.pattern.endswith("]+") and rule.pattern.startswith("[")
    asked = F.rlike(text, F.lit(f"{rule.pattern[:-1]}{{{rule.least},}}") if whole else pattern)
    return F.when(asked, spans).otherwise(F.array().cast(f"array<{span}>"))


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (trigram, doc_id, text_key) of the asked trigrams in each text."""
    low = ascii_lower(F.col("text"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return (keyed.select("doc_id", "text_key", low.alias("low"))
            .select("doc_id", "text_key", F.explode(held).alias("trigram")))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(doc_id, text_key, rules: kinds whose trigram query the text meets)."""
    ways = [(r.kind, f"{r.kind}/{i}", t, len(s)) for r in rules
            for i, s in enumerate(trigram_query(r.pattern)) for t in sorted(s)]
    if not ways:
        return None
    spark = keyed.sparkSession
    asked = spark.createDataFrame(ways, "kind string, way string, trigram string, need int")
    index = stage(postings(keyed, sorted({w[2] for w in ways})), "trigram-postings")
    # asked is a fixed table of a few dozen rows
    met = (index.join(F.broadcast(asked), "trigram")
           .groupBy("doc_id", "text_key", "kind", "way", "need").agg(F.count_distinct("trigram").alias("n"))
           .where("n = need"))
    return stage(met.groupBy("doc_id", "text_key").agg(F.collect_set("kind").alias("kinds")), "trigram-candidates")


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, others) and ``secret_spans``:
    array of (start, rank of the rule, end, kind) by start, then rule.

    Places are code points, the end exclusive.  Null texts count as empty.  A
    rule's matches are leftmost and do not overlap; those whose group is too
    short are dropped.  Repeated rows and null doc_ids stay.
    """
    key, text = F.xxhash64("text"), F.coalesce(F.col("text"), F.lit(""))
    found = candidates(docs.select("doc_id", "text", key.alias("text_key")).where("text is not null"), rules)
    d = docs.withColumn("__secret_key", key)
    if found is not None:
        c = small(found).select(F.col("doc_id").alias("__secret_doc"), F.col("text_key").alias("__secret_hash"),
                                F.col("kinds").alias("__secret_kinds"))
        d = d.join(c, F.col("doc_id").eqNullSafe(F.col("__secret_doc"))
                   & (F.col("__secret_key") == F.col("__secret_hash")), "left").drop("__secret_doc", "__secret_hash")
    else:
        d = d.withColumn("__secret_kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for rank, rule in enumerate(rules):
        spans = _matches(text, rule, rank)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("__secret_kinds", rule.kind), spans).otherwise(none)
        parts.append(spans)
    return (d.withColumn("secret_spans", F.sort_array(F.flatten(F.array(*parts))))
            .drop("__secret_key", "__secret_kinds"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row of ``find``."""
    base = [r for r in rules if r.base]
    spans = F.col("secret_spans")
    joined = lambda a: F.array_join(F.transform(
        a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.array(*[F.lit(r.kind) for r in base])
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[count(r.kind).alias(f"n_{r.kind}") for r in base],
        F.sha2(joined(F.filter(spans, lambda s: F.array_contains(kinds, s["kind"]))), 256).alias("base_sha256"),
        joined(spans).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets (overlaps: the first)."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, s):
        begin = F.greatest(acc["at"], s["start"])
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]),
                     F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]")))
                     .otherwise(F.lit(""))).alias("out")))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(text.isNotNull() & (F.size(spans) > 0), F.aggregate(spans, zero, add, rest)).otherwise(text)
