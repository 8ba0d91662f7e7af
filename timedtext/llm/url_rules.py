"""URL filters: fixed prefix rules, then association rules mined from the pages they judge.

Pages that a fixed rule judges are the labelled transactions: the tokens of their url and the
verdict. FP-growth finds the frequent combinations; those that imply a verdict with enough
confidence are the learned rules. A rule is indexed by its rarest token only, so a page meets
the few rules of its tokens' lists, and is matched when it has all tokens of a rule. Of matching
rules the surest decides, then the more frequent, the longer and, last, ``block``.

Pages are judged once for each distinct host and path. All is DataFrame work.

Defined results: a null url, or one without ``://``, has an empty host and path, no token and
the verdict ``allow``, as has every page that no rule fits. Repeated rows get a result each. An
empty table, or one without a labelled page, gives no learned rule. Only ``page_id`` and ``url``
are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm.common import lower_ascii, table
from timedtext.session import stage_table

# Fixed rules of the contract: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
LABEL = "verdict="


def parsed(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return pages.select(
        "page_id",
        lower_ascii(F.regexp_extract(url, URL, 1)).alias("host"),
        F.regexp_extract(url, URL, 2).alias("path"),
    )


def fixed(host: Column, path: Column, value: str) -> Column:
    """The name or the verdict of the longest fitting rule, else null."""
    found = []
    for name, prefix, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found.append(F.when(fits, F.lit(name + prefix if value == "rule" else verdict)))
    return F.coalesce(*found)


def tokens(host: Column, path: Column) -> Column:
    """Distinct host labels and their words, path segments and their words; numbers as one."""

    def words(text: Column, parts: str, mark: str) -> Column:
        whole = F.split(text, parts)
        small = F.flatten(F.transform(whole, lambda x: F.split(x, "[-_]")))
        shaped = F.transform(
            F.concat(whole, small), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0"))
        )
        return F.filter(shaped, lambda x: x != mark)

    return F.array_distinct(F.concat(words(host, "[.:@]", "host="), words(path, "[/.]", "path=")))


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Learned rules: antecedent tokens, the index token, verdict, confidence and support."""
    rows = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    single = model.freqItemsets.filter(F.size("items") == 1).select(
        F.col("items")[0].alias("token"), "freq"
    )
    rules = model.associationRules.filter(
        F.col("consequent")[0].startswith(LABEL)
        & ~F.exists("antecedent", lambda x: x.startswith(LABEL))
    ).select(
        F.array_sort("antecedent").alias("antecedent"),
        F.substring(F.col("consequent")[0], len(LABEL) + 1, 1000).alias("verdict"),
        "confidence",
        "support",
    )
    index = (
        rules.select("antecedent", "verdict", F.explode("antecedent").alias("token"))
        .join(single, "token")
        .groupBy("antecedent", "verdict")
        .agg(F.min_by("token", F.struct("freq", "token")).alias("token"))
    )
    return rules.join(index, ["antecedent", "verdict"])


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path and learned verdict of those urls (host, path, tokens) that a rule fits."""
    hit = urls.select("*", F.explode("tokens").alias("token")).join(rules, "token")
    hit = hit.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct("confidence", "support", F.size("antecedent").alias("size"), "verdict")
    return hit.groupBy("host", "path").agg(F.max(rank)["verdict"].alias("learned"))


def filter_urls(
    pages: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    host, path = F.col("host"), F.col("path")
    judged = parsed(pages).withColumns(
        {"rule": fixed(host, path, "rule"), "verdict": fixed(host, path, "verdict")}
    )
    labelled = judged.filter("rule IS NOT NULL").select(tokens(host, path).alias("tokens"), "verdict")
    if labelled.isEmpty():
        return judged.withColumn("verdict", F.coalesce("verdict", F.lit(DEFAULT)))
    rules = stage_table(mine(labelled, min_support, min_confidence), "url-rules")
    urls = judged.filter("rule IS NULL").select("host", "path").distinct()
    learned = match(urls.withColumn("tokens", tokens(host, path)), rules)
    joined = judged.join(learned, ["host", "path"], "left")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "learned", F.lit(DEFAULT)).alias("verdict")
    )


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
