"""URL filters by association rules (operator 2).

A URL becomes a set of tokens (host labels, path words, query names,
depth).  Spark's FP-growth finds the token sets that are frequent among the
URLs with a bad label; their share of bad rows among all labelled rows is
the rule's confidence.  Rules need enough support and confidence, a lift
that is statistically sure, and must beat the rules made by leaving out one
token.  All URLs are then matched through an inverted index that lists a
rule under its rarest token.

Host and path rules given by hand come first: they fit a host and all its
subdomains, and the longest one decides; mined rules decide the rest.

Plan: URLs are matched once per distinct URL (a hot URL is one row), the
join on tokens only carries tokens that rules use, rules too common to
shuffle well are split by Spark's skew handling, and hits are counted with
map-side sums per URL.

Defined cases: null URLs and URLs without :// have an empty host and path
and no tokens, and are allowed; null labels do not teach; without labelled
bad URLs no rules are mined; of several hand rules of one length the
first wins; repeated rows each get a row; an empty table gives an empty
result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermart.llm.common import col
from ledgermart.session import materialize

#: Hand rules: verdict, host suffix, path prefix.
HAND_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
              ("allow", "org", "/fr/")]

#: Pruning: share and number of bad rows, confidence, lift that is sure at ``Z`` deviations, tokens of a rule.
MIN_SUPPORT, MIN_SUPPORT_ROWS, MIN_CONFIDENCE, MIN_LIFT, Z, MAX_TOKENS = 0.002, 5, 0.6, 1.5, 3.3, 3


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host labels and their pairs with the label
    above, path words without digits, the depth, query names."""
    host, path = host_of(url), path_of(url)
    labels = F.array_remove(F.split(host, r"\."), "")
    words = F.array_remove(F.array_distinct(F.split(F.lower(F.regexp_replace(path, "[0-9]+", "")), r"[^a-z\x80-￿]+")), "")
    names = F.regexp_extract_all(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""), F.lit(r"[?&]([^=&]+)"), F.lit(1))
    pieces = F.flatten(F.transform(labels, lambda x: F.array_remove(F.split(x, "-"), "")))
    return F.when(host != "", F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(pieces, lambda x: F.concat(F.lit("word:"), x)),
        F.transform(words, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(names, lambda x: F.concat(F.lit("query:"), x)),
        F.array(F.concat(F.lit("depth:"), F.size(F.split(path, "/")).cast("string")))))).otherwise(
        F.array().cast("array<string>"))


def _sure_share(hits: Column, n: Column, z: float) -> Column:
    """Lower end of the Wilson interval of hits / n."""
    share = hits / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_support_rows: int = MIN_SUPPORT_ROWS,
               min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, max_tokens: int = MAX_TOKENS,
               z: float = Z) -> DataFrame:
    """(rule, tokens, key, confidence, support_rows) from rows (tokens, bad).

    Token sets frequent among the bad rows are counted over all labelled
    rows; the key is the set's rarest token."""
    rows = materialize(labelled.filter((F.size("tokens") > 0) & F.col("bad").isNotNull()).select(
        F.monotonically_increasing_id().alias("url_key"), "tokens", "bad"), "url-labels")
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).first()
    if not counted["bad"]:
        return rows.sparkSession.createDataFrame(
            [], "rule long, tokens array<string>, key string, confidence double, support_rows long")
    sets = FPGrowth(itemsCol="tokens", minSupport=min(1.0, max(min_support, min_support_rows / counted["bad"]))).fit(
        rows.filter("bad").select("tokens")).freqItemsets
    sets = sets.filter(F.size("items") <= max_tokens).select(
        F.sort_array("items").alias("tokens"), F.col("freq").alias("support_rows"))
    common = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    keys = (sets.select("tokens", "support_rows", F.explode("tokens").alias("token")).join(common, "token")
            .groupBy("tokens", "support_rows").agg(F.min(F.struct("n", "token")).alias("rarest")))
    sets = materialize(keys.select(F.xxhash64("tokens").alias("rule"), "tokens", F.col("rarest.token").alias("key"),
                                   "support_rows"), "url-sets")
    seen = matches(rows, sets).groupBy("rule").agg(F.count(F.lit(1)).alias("seen"))
    rules = sets.join(seen, "rule").withColumn("confidence", F.col("support_rows") / F.col("seen")).filter(
        (F.col("confidence") >= min_confidence)
        & (_sure_share(F.col("support_rows"), F.col("seen"), z) >= min_lift * counted["bad"] / counted["n"]))
    less = rules.select("rule", "confidence", "tokens", F.explode("tokens").alias("left_out")).select(
        "rule", "confidence", F.xxhash64(F.array_remove("tokens", F.col("left_out"))).alias("smaller"))
    as_good = less.join(rules.select(F.col("rule").alias("smaller"), F.col("confidence").alias("c")), "smaller").filter(
        F.col("c") >= F.col("confidence")).select("rule").distinct()
    return materialize(rules.join(as_good, "rule", "left_anti").select(
        "rule", "tokens", "key", "confidence", "support_rows"), "url-rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_key, rule) pairs where the URL has all tokens of the rule: the
    inverted index lists a rule under its rarest token only, so candidates
    are few; the others are looked up in the URL's own set."""
    index = rules.select("rule", F.col("key").alias("token"), F.col("tokens").alias("rule_tokens"))
    spread = urls.select("url_key", "tokens", F.explode(F.array_distinct("tokens")).alias("token"))
    return (spread.join(index, "token")
            .filter(F.size(F.array_intersect("rule_tokens", "tokens")) == F.size("rule_tokens")).select("url_key", "rule"))


def hand_rule(host: Column, path: Column, rules=HAND_RULES) -> tuple[Column, Column]:
    """The longest hand rule that fits, and its verdict (null if none)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, suffix, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name = F.when(fits, F.lit(suffix + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
               label_id: str = "doc_id", *, rules=HAND_RULES, **mining) -> DataFrame:
    """One row per page: host, path, hand rule, verdict and how many mined
    rules hit.  ``labels`` (label_id, quality, toxic) mark bad pages."""
    p = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"))
    taught = labels.groupBy(col(label_id).alias("label_id")).agg(
        F.max((F.coalesce(col("toxic"), F.lit(0)) == 1) | (F.coalesce(col("quality"), F.lit(1)) == 0)).alias("bad"))
    teach = p.join(taught, p["page_id"] == taught["label_id"]).select(url_tokens(F.col("url")).alias("tokens"), "bad")
    mined = mine_rules(teach, **mining)
    # a fixed number of partitions: URLs are small, matching them is not, so merging small partitions would leave few tasks
    parts = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = p.filter("url IS NOT NULL").select("url").repartition(parts, "url").distinct()
    keyed = urls.select(F.col("url").alias("url_key"), url_tokens(F.col("url")).alias("tokens"))
    hit = matches(keyed, mined).join(mined.select("rule", "confidence"), "rule").groupBy("url_key").agg(
        F.count(F.lit(1)).alias("n_rules"), F.max("confidence").alias("confidence"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = hand_rule(F.col("host"), F.col("path"), rules)
    judged = p.join(hit, p["url"] == hit["url_key"], "left").withColumn("host", host).withColumn("path", path)
    return judged.select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("n_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"))
