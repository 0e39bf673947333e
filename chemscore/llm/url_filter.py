"""URL filters by association rules.

FP-growth mines combinations of URL tokens that go with a blocking label.
Rules pruned by support and confidence are kept in an inverted index under
their rarest token; a page's tokens look up the rules, and a rule fires if all
its tokens are the page's.  Fixed host and path rules decide first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chemscore.llm.common import UPPER, LOWER, hash_share, small, stage

#: Fixed values: (host, path, verdict).
BASE_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Labelled pages that are mined (a documented bound; chosen by a hash of the id).
FIT_ROWS = 50_000
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Blocked pages a rule must stand on, whatever the share, and how many standard errors its confidence must be
#: above the share of blocked pages (many rules are tried, so chance must be rare for each).
MIN_PAGES = 20
ERRORS = 4.0
_BLOCK = "=block"


def host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    found = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(at > 0, found).otherwise("")


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def base_rule(host_column: Column, path_column: Column, rules=BASE_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_column == h) | F.endswith(host_column, F.lit(f".{h}"))) & F.startswith(path_column, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host suffixes and labels, path parts
    (digits as #), the last part's extension, query keys, fragment."""
    at = F.locate("://", url)
    h, p = host(url), path(url)
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    suffix = F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)
    parts = F.transform(F.filter(F.split(p, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    keys = F.filter(F.transform(query, lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")
    fragment = F.regexp_extract(url, "#(.*)$", 1)
    tag = lambda t, a: F.transform(a, lambda x: F.concat(F.lit(t), x))
    one = lambda t, x: F.when(x != "", F.array(F.concat(F.lit(t), x))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(
        one("scheme:", F.when(at > 0, F.substring(url, F.lit(1), at - 1)).otherwise("")), tag("host:", labels),
        one("site:", suffix), tag("path:", parts), tag("key:", keys), one("fragment:", fragment)))


def lower_bound(share: Column, n: Column, errors: float = ERRORS) -> Column:
    """Wilson's lower bound of a share seen in n cases."""
    z2 = errors * errors
    return (share + z2 / (2 * n) - errors * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def _closed(rows: DataFrame) -> DataFrame:
    """The rows with one token of each group of tokens that always stand
    together: their subsets would all be as frequent, 2^n sets for n tokens."""
    page = F.xxhash64("page_id", "url_key")
    each = rows.select("page_id", "url_key", "block", page.alias("one"), F.xxhash64(page, F.lit(1)).alias("two"),
                       F.explode_outer("tokens").alias("token"))
    same = each.where("token is not null").groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor("one").alias("x1"), F.bit_xor("two").alias("x2"))
    kept = stage(same.groupBy("n", "x1", "x2").agg(F.min("token").alias("token")).select("token"), "url-tokens")
    named = each.join(small(kept.withColumn("kept", F.lit(True))), "token", "left")
    return stage(named.groupBy("page_id", "url_key", "block").agg(
        F.collect_set(F.when(F.col("kept"), F.col("token"))).alias("tokens")), "url-baskets")


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rules (rule_id, rarest token, tokens, confidence, support) for blocking.

    A page is one to block if a label of its id says quality 0 or toxic 1.
    A rule is kept if it stands on ``MIN_PAGES`` blocked pages, if the lower
    bound of its confidence is above the share of blocked pages, and if no rule
    with fewer of its tokens is as confident.  Where no combination says more
    than chance, there are no rules.
    """
    labelled = (labels.where("doc_id is not null")
                .groupBy(F.col("doc_id").alias("page_id"))
                .agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("block")))
    # repeated page rows teach once
    rows = stage(pages.where("url is not null").select("page_id", "url").distinct().join(labelled, "page_id")
                 .where("block is not null").select("page_id", "block", F.xxhash64("url").alias("url_key"),
                                                    tokens(F.col("url")).alias("tokens")),
                 "url-labelled")
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(hash_share(F.xxhash64("page_id", "url_key"), fit_rows / n))
    rows = _closed(rows)
    size = rows.agg(F.count("*").alias("n"), F.sum("block").alias("blocked")).first()
    baskets = rows.select(F.when(F.col("block") == 1, F.concat("tokens", F.array(F.lit(_BLOCK))))
                          .otherwise(F.col("tokens")).alias("items"))
    empty = "rule_id long, rarest string, rule_tokens array<string>, confidence double, support double"
    if (size.blocked or 0) < MIN_PAGES:
        return rows.sparkSession.createDataFrame([], empty)
    least = max(min_support, MIN_PAGES / size.n)
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    sets = stage(model.freqItemsets, "url-itemsets")
    found = (model.associationRules.where(F.col("consequent") == F.array(F.lit(_BLOCK)))
             .where(lower_bound(F.col("confidence"), F.col("support") * size.n / F.col("confidence")) > size.blocked / size.n)
             .select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "support"))
    rules = stage(found.withColumn("rule_id", F.xxhash64("rule_tokens")), "url-rules")
    # A rule goes if one with all its tokens but one (or more) is as confident: met under each single token.
    a = rules.select("rule_id", "rule_tokens", "confidence", F.explode("rule_tokens").alias("token"))
    b = rules.select(F.col("rule_id").alias("less_id"), F.col("rule_tokens").alias("less"),
                     F.col("confidence").alias("less_confidence"), F.element_at("rule_tokens", 1).alias("token"))
    worse = (a.join(b, "token").where((F.size("less") < F.size("rule_tokens"))
                                      & (F.col("less_confidence") >= F.col("confidence"))
                                      & (F.size(F.array_except("less", "rule_tokens")) == 0))
             .select("rule_id").distinct())
    counts = sets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    rarest = (a.join(worse, "rule_id", "left_anti").join(counts, "token")
              .groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest")))
    return stage(rules.join(rarest, "rule_id").select("rule_id", "rarest", "rule_tokens", "confidence", "support"),
                 "url-index")


def judge(pages: DataFrame, rules: DataFrame, base_rules=BASE_RULES) -> DataFrame:
    """One row per page row: page_id, host, path, rule (the base rule, else
    null), verdict (the base rule's; else block if a mined rule fires, else
    allow), mined (tokens of the most confident mined rule that fires).

    Null urls and urls without :// have empty host and path and fit no base
    rule.  Repeated rows and null ids stay; other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    keyed = pages.withColumn("url_key", F.xxhash64("url"))
    index = small(rules)
    # verdicts of distinct urls: copies of a url are looked up once
    urls = keyed.where("url is not null").groupBy("url_key", "url").agg(F.lit(1).alias("one")).drop("one")
    fired = (urls.select("url_key", "url", tokens(F.col("url")).alias("tokens"))
             .select("url_key", "url", "tokens", F.explode("tokens").alias("rarest"))
             .join(index, "rarest").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
             .groupBy("url_key", "url").agg(F.max(F.struct("confidence", "support", "rule_tokens")).alias("best")))
    fired = stage(fired.select(F.col("url_key").alias("k"), F.col("url").alias("u"),
                               F.array_join("best.rule_tokens", " ").alias("mined")), "url-fired")
    h, p = host(F.coalesce("url", F.lit(""))), path(F.coalesce("url", F.lit("")))
    judged = keyed.join(small(fired), (F.col("url_key") == F.col("k")) & (F.col("url") == F.col("u")), "left")
    judged = judged.select("page_id", h.alias("host"), p.alias("path"), "mined")
    rule, verdict = base_rule(F.col("host"), F.col("path"), base_rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
                         .alias("verdict"), "mined")
