"""URL filters: fixed host and path rules, and association rules mined from labelled URLs. DataFrame functions only.

FP-growth finds frequent combinations of URL tokens together with a label. A combination becomes a rule if its
support and its confidence in the label suffice and no part of it is as good. The rules lie in an inverted index under
their rarest token, and a URL is compared with the rules that its tokens find there. For the query, the URLs that
the fixed rules judge are the labelled ones, and only they are mined: the others are what mined rules are for. Tokens
that say no more than the fixed rules' own hosts and paths are left out, since they would only repeat which URLs have
a label."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
#: Tokens of a combination at most, its label not counted.
MAX_TOKENS = 3
DEFAULT = "allow"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(url, PARTS, 1), upper, lower), F.regexp_extract(url, PARTS, 2)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: the last label of its host, the two last, words of the others, and its first path part
    unless that is a number."""
    labels = F.split(host, r"\.")
    first = F.split_part(path, F.lit("/"), F.lit(2))
    words = F.filter(F.split(host, r"[.\-]"), lambda x: x != "")
    tail = lambda n: F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), F.lit(n)), "."))
    own = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.when(
        host != "",
        F.array_distinct(
            F.concat(
                F.array(tail(1), tail(2)),
                F.transform(own, lambda x: F.concat(F.lit("w:"), x)),
                F.when((first != "") & ~first.rlike(r"^[0-9]+(\.\w+)?$"), F.array(F.concat(F.lit("p:"), first))).otherwise(F.array().cast("array<string>")),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def general(tokens: Column, rules=RULES) -> Column:
    """The tokens that can tell something beyond the fixed rules: no domains above, at or below their hosts, no words of
    these and not the first part of their paths."""
    hosts = sorted({h for _, h, _ in rules})
    told = {f"w:{w}" for h in hosts for w in h.replace("-", ".").split(".")} | {f"p:{p.split('/')[1]}" for _, _, p in rules if p.count("/") and p != "/"}

    def beyond(x: Column) -> Column:
        found = ~x.isin(sorted(told)) if told else F.lit(True)
        domain = F.concat(F.lit("."), F.substring(x, 3, 1 << 30))
        for h in hosts:
            found = found & ~(x.startswith("d:") & (domain.endswith("." + h) | F.lit("." + h).endswith(domain)))
        return found

    return F.filter(tokens, beyond)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled: tokens (distinct), label (rows where it is null count against every rule). Rules: antecedent, key (its rarest token), verdict, confidence, support."""
    label = F.when(F.col("label").isNotNull(), F.array(F.concat(F.lit("label:"), F.col("label")))).otherwise(F.array().cast("array<string>"))
    items = labelled.select(F.concat(F.col("tokens"), label).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).freqItemsets
    is_label = lambda x: x.startswith("label:")
    found = found.select(
        F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("antecedent"),
        F.get(F.filter("items", is_label), 0).alias("label"),
        "freq",
    ).where(F.size("antecedent") <= MAX_TOKENS)
    all_of = found.where("label IS NULL").select("antecedent", F.col("freq").alias("all"))
    rules = (
        found.where("label IS NOT NULL AND size(antecedent) > 0").join(all_of, "antecedent")
        .select("antecedent", F.substring_index("label", ":", -1).alias("verdict"), (F.col("freq") / F.col("all")).alias("confidence"), F.col("freq").alias("support"))
        .where(F.col("confidence") >= min_confidence)
    )
    # a rule goes if dropping one of its tokens leaves a rule with the same verdict that is as sure
    shorter = rules.where("size(antecedent) > 1").select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("less"))
    shorter = shorter.select("antecedent", "verdict", "confidence", F.array_remove("antecedent", F.col("less")).alias("part"))
    parts = rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("of_part"))
    weak = shorter.join(parts, ["part", "verdict"]).where("of_part >= confidence").select("antecedent", "verdict").distinct()
    rules = rules.join(weak, ["antecedent", "verdict"], "left_anti")
    single = all_of.where("size(antecedent) = 1").select(F.get("antecedent", F.lit(0)).alias("token"), F.col("all").alias("of_token"))
    by_token = rules.select("*", F.explode("antecedent").alias("token")).join(single, "token")
    return by_token.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("of_token", "token")).alias("key"))


def match(signatures: DataFrame, rules: DataFrame) -> DataFrame:
    """signatures: signature, tokens. The best rule for each that one fits: surest, then longest, then blocking."""
    index = rules.select("key", "antecedent", F.col("verdict").alias("mined_verdict"), "confidence", "support")
    looked_up = signatures.select("signature", "tokens", F.explode("tokens").alias("key"))
    fits = F.size(F.array_except("antecedent", "tokens")) == 0
    hits = looked_up.join(index, "key").where(fits)
    order = F.struct(F.col("confidence"), F.size("antecedent"), F.col("mined_verdict") == "block", F.col("support"), F.array_join("antecedent", " "))
    best = hits.groupBy("signature").agg(F.max_by(F.struct("mined_verdict", F.array_join("antecedent", " ").alias("mined_rule"), "confidence"), order).alias("best"))
    return best.select("signature", "best.*")


def judge_urls(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, mined_rule, confidence.

    The verdict is the fixed rule's, else that of the best mined rule, else the default. Null URLs and those without
    :// have empty host and path, no tokens and the default verdict. Repeated rows each come back; equal URL tokens are
    judged once. An empty table gives no rows; without labelled URLs nothing is mined."""
    host, path = host_and_path(pages["url"])
    rows = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    text, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", text.alias("rule"), verdict.alias("fixed_verdict"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    rows = rows.withColumn("signature", F.array_join("tokens", " "))
    labelled = rows.where("fixed_verdict IS NOT NULL").select(general(F.col("tokens"), rules).alias("tokens"), F.col("fixed_verdict").alias("label"))
    mined = mine(labelled, min_support, min_confidence)
    signatures = rows.groupBy("signature").agg(F.first("tokens").alias("tokens"))
    best = match(signatures, mined)
    return rows.join(best, "signature", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("fixed_verdict", "mined_verdict", F.lit(default)).alias("verdict"), "mined_rule", "confidence"
    )
