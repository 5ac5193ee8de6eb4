"""URL filter by association rules.

Tokens of a URL's host and path are items; pages with a label add one for it. FP-growth mines the
combinations that go with blocked pages. Rules are pruned by support and confidence, and by rules
on fewer tokens that are as certain. A page meets the rules through an inverted index: a rule is
filed under its rarest token, and its other tokens are looked up in the page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from themeloom.workspace import Workspace

BLOCKED = "label:block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Given rules: (host, path, verdict). They fit the host and its subdomains.
GIVEN = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


@dataclass(frozen=True)
class UrlParams:
    """A rule needs ``support`` as a share of the labelled pages, ``least`` of them in any case;
    ``confidence`` is the share of blocked ones among those that hold its tokens, and must be above that among
    all. With a ``certainty`` above 0 it must be so by chance's reach: so many standard deviations, by a Wilson
    bound. The share of support bounds the rules: at most one over it times the tokens of a page are frequent tokens."""

    support: float = 0.005
    least: int = 5
    confidence: float = 0.5
    certainty: float = 3.0
    most_tokens: int = 3
    given: tuple[tuple[str, str, str], ...] = GIVEN


def host_of(url: Column) -> Column:
    """Host in lower case (A-Z), empty without ``://`` or for null."""
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest given rule that fits, as (rule, verdict); null if none fits."""
    fits = F.lit(None).cast("struct<rule: string, verdict: string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        own = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        fits = F.when(own, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the host, its labels, words in them, and words of the path without digits,
    each marked by where it stands."""
    labels = F.split(host, r"\.")
    words = F.regexp_extract_all(host, F.lit(r"[a-z]+"), F.lit(0))
    steps = F.regexp_extract_all(F.lower(path), F.lit(r"[\p{L}]+"), F.lit(0))
    mark = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind), x))
    every = F.concat(F.array(F.concat(F.lit("host:"), host)), mark("label:.", labels), mark("word:", words), mark("path:", steps))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def mine_rules(space: Workspace, labelled: DataFrame, params: UrlParams) -> DataFrame:
    """(rule_id, tokens, index, confidence) from (tokens, blocked). ``index`` is the rule's rarest token.

    Only token combinations are counted against the labels; the rule count is bounded by the support.
    """
    items = F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens"))
    baskets = labelled.select(items.alias("items")).where(F.size("items") > 0)
    labels = baskets.count()
    share = min(1.0, max(params.support, params.least / max(labels, 1)))
    model = FPGrowth(minSupport=share, minConfidence=params.confidence).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", BLOCKED))
    # Pages with the tokens, and the lower end of what share of them may be blocked in truth.
    p, n, z = F.col("confidence"), F.col("support") * labels / F.col("confidence"), params.certainty
    lower = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    rules = rules.where(lower > p / F.col("lift"))
    rules = rules.where(F.size("antecedent") <= params.most_tokens).select(
        F.sort_array("antecedent").alias("tokens"), "confidence"
    )
    rules = space.table(rules, "mined")
    # A rule falls if a part of its tokens is as certain.
    x, y = rules.alias("x"), rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("part"), F.col("confidence").alias("sure"))
    smaller = (
        x.select(F.explode("tokens").alias("token"), "tokens", "confidence")
        .join(y, "token")
        .where((F.size("part") < F.size("tokens")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0))
        .select("tokens")
        .distinct()
    )
    kept = rules.join(smaller, "tokens", "left_anti")
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    spread = kept.select("tokens", "confidence", F.explode("tokens").alias("token")).join(often, "token")
    filed = spread.groupBy("tokens", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("index"))
    return space.table(filed, "rules")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(rid, confidence) of the pages that hold all tokens of a rule: the best of its rules."""
    posted = pages.select("rid", "tokens", F.explode("tokens").alias("index"))
    met = posted.join(rules.select(F.col("tokens").alias("rule"), "confidence", "index"), "index")
    whole = met.where(F.size(F.array_except("rule", "tokens")) == 0)
    return whole.groupBy("rid").agg(F.max(F.struct("confidence", "rule")).alias("best")).select(
        "rid", "best.confidence", F.col("best.rule").alias("mined_rule")
    )


def filter_urls(
    space: Workspace,
    pages: DataFrame,
    labels: DataFrame,
    params: UrlParams = UrlParams(),
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (of the given ones, else null), verdict
    (that rule's, else block where a mined rule fits), mined_rule (tokens) and confidence.

    ``labels`` has (key, blocked); a page may have none, and one with several counts as blocked if any
    says so. A null URL, or one without ``://``, has an empty host and path, fits no rule and is
    allowed. Repeated rows are judged alike. An empty table gives no rows, and without labels nothing
    is mined.
    """
    space = space.part()
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"))
    read = read.select("page_id", host.alias("host"), path.alias("path"))
    read = read.withColumn("tokens", url_tokens(F.col("host"), F.col("path"))).withColumn("rid", F.monotonically_increasing_id())
    read = space.table(read, "pages")
    judged = labels.groupBy(F.col(key).alias("page_id")).agg(F.max("blocked").alias("blocked")).where("blocked is not null")
    labelled = space.table(read.join(judged, "page_id").select("tokens", "blocked"), "labelled")
    matched = match_rules(read, mine_rules(space, labelled, params))
    fits = given_rule(F.col("host"), F.col("path"), params.given)
    found = read.join(matched, "rid", "left").withColumn("fits", fits)
    mined = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", mined).alias("verdict"),
        "mined_rule", "confidence",
    )
