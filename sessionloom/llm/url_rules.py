"""URL filtering by association rules.

Labelled URLs become sets of tokens (host suffixes, path words, query keys);
FP-growth mines combinations of tokens that go with the label; rules that are
weak, that chance explains, or that are no better than one with fewer tokens
are pruned. A rule is filed under its rarest token. URLs look their tokens up in that inverted index, and a
rule fires if all its tokens are there. All of it is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import checkpointed

#: (host and path, verdict) that hold before any mined rule; the longest that fits wins.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Share and number of labelled URLs that a rule holds for at least, and its confidence at least.
MIN_SUPPORT = 0.002
MIN_ROWS = 10
MIN_CONFIDENCE = 0.8
#: Chance that any of all the combinations tried would seem so sure if labels did not depend on URLs, at most.
CHANCE = 0.01
#: Labelled URLs that rules are mined from at most, by hashed id.
MAX_LABELLED = 50_000
#: Rules up to which the index is broadcast; beyond, the join shuffles.
BROADCAST_RULES = 5_000
BAD = "=bad"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    return F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)"))


def split_url(df: DataFrame) -> DataFrame:
    """Adds host and path to rows with a column `url`; both empty for a null url or one without `://`."""
    rest = df.withColumn("__rest", F.coalesce(_rest(F.col("url")), F.lit("")))
    rest = rest.withColumn("__host", F.regexp_extract("__rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), r"^[^?#]*", 0)
    return rest.withColumn("path", path).withColumn("host", F.translate("__host", _UPPER, _LOWER)).drop("__rest", "__host")


def listed_rule(rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest listed rule that fits host and path; null without one."""
    out = F
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        out = out.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return out.otherwise(F.lit(None)) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens() -> Column:
    """Distinct tokens of a row with url, host and path: h: host suffixes, w: path words, q: query keys."""
    labels = F.split("host", r"\.")
    hosts = F.expr("transform(sequence(1, size(split(host, '\\\\.'))), i -> concat('h:', array_join(slice(split(host, '\\\\.'), -i, i), '.')))")
    words = F.transform(F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.rlike(r"^\d+$")), lambda w: F.concat(F.lit("w:"), w))
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.concat(F.lit("q:"), F.substring_index(q, "=", 1)))
    return F.array_distinct(F.concat(F.when(F.size(labels) > 0, F.when(F.col("host") != "", hosts).otherwise(F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), words, keys))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Rules (antecedent, lists, confidence, support, lift) from rows (page_id, url, bad).

    All rules that pass support, confidence and the test against chance, but
    those that one with a part of their tokens beats. The test is Chernoff's
    bound: if a share `base` of all labelled URLs is bad, then n URLs have a bad
    share of `confidence` or more with a chance of at most
    exp(-n * KL(confidence, base)), and that times the number of combinations
    tried must not exceed `CHANCE`. Tokens that stand in the same labelled URLs
    are mined as one: a rule's `lists` has them all, any one of which will do,
    and its antecedent the first of each. A token that is bad wherever it stands
    needs no company. Without labelled rows there are none.
    """
    rows = labelled.where("bad IS NOT NULL").orderBy(F.xxhash64("page_id", "url"), "page_id").limit(max_labelled)
    rows = split_url(rows).withColumn("tokens", url_tokens()).where((F.size("tokens") > 0) | F.col("bad"))
    rows = checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"))
    total, n_bad = rows.agg(F.count("*"), F.coalesce(F.count_if("bad"), F.lit(0))).first()
    least = max(math.ceil(min_support * total), MIN_ROWS)
    spread = rows.select("row", "bad", F.explode("tokens").alias("token"))
    places = spread.groupBy("token").agg(F.array_sort(F.collect_list("row")).alias("places"), F.count_if("bad").alias("hits")).where(F.col("hits") >= least)
    alike = places.groupBy("places", "hits").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    alike = checkpointed(alike.select("item", "tokens", "hits", F.size("places").alias("n")))
    sure = alike.where("hits = n").select(F.explode("tokens").alias("token"), "hits")
    sure = sure.select(F.array("token").alias("antecedent"), F.array(F.array("token")).alias("lists"), F.lit(1.0).alias("confidence"), (F.col("hits") / total).alias("support"), F.lit(total / max(n_bad, 1)).alias("lift"))
    items = spread.join(alike.where("hits < n").select(F.col("item").alias("token")), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    none = F.array().cast("array<string>")
    basket = F.concat(F.coalesce("items", none), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(none))
    baskets = rows.join(items, "row", "left").select(basket.alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(least / max(total, 1), 1.0), minConfidence=min_confidence).fit(baskets)
    tried = model.freqItemsets.where(~F.array_contains("items", BAD)).count() + alike.count()
    base = n_bad / max(total, 1)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).where(_beyond_chance(total, base, tried))
    sure = sure.where(_beyond_chance(total, base, tried))
    rules = _unbeaten(checkpointed(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support", "lift")))
    lists = rules.select("*", F.explode("antecedent").alias("item")).join(alike.select("item", "tokens"), "item")
    lists = lists.groupBy("antecedent", "confidence", "support", "lift").agg(F.collect_list("tokens").alias("lists"))
    return checkpointed(lists.select("antecedent", "lists", "confidence", "support", "lift").unionByName(sure))


def _unbeaten(rules: DataFrame) -> DataFrame:
    """Rules without those that one with a part of their tokens, as sure, makes needless.

    From the shortest on: those of a size are measured against the shorter ones
    that are left, which is enough, as what beats a rule that went beats all that
    it beats. So correlated tokens, of which very many combinations are as sure,
    are told off by the few that are not.
    """
    sizes = sorted(r[0] for r in rules.select(F.size("antecedent")).distinct().collect())  # a URL's tokens at most
    kept, rest = None, rules
    for size in sizes:
        level = rest.where(F.size("antecedent") == size)
        kept = level if kept is None else kept.unionByName(level)
        if size == sizes[-1]:
            break
        # of what is left, what this level beats goes
        index = inverted_index(level.withColumn("lists", F.transform("antecedent", lambda t: F.array(t)))).select("token", F.flatten("lists").alias("part"), F.col("confidence").alias("as_sure"))
        longer = rest.where(F.size("antecedent") > size)
        met = longer.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(index, "token")
        beaten = met.where((F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0))
        rest = checkpointed(longer.join(beaten.select("antecedent").distinct(), "antecedent", "left_anti"))
    return rules if kept is None else kept


def _beyond_chance(total: int, base: float, tried: int) -> Column:
    """Is a rule, with its support and confidence, beyond what chance gives?"""
    if not 0 < base < 1:
        return F.lit(False)
    good = 1 - F.col("confidence")
    apart = F.col("confidence") * F.log(F.col("confidence") / base) + F.when(good > 0, good * F.log(good / (1 - base))).otherwise(0.0)
    return (F.col("confidence") > base) & (F.col("support") * total / F.col("confidence") * apart >= math.log(max(tried, 1) / CHANCE))


def inverted_index(rules: DataFrame) -> DataFrame:
    """(token, lists, confidence): each rule under the tokens of its list that the fewest rules have."""
    spread = rules.select("antecedent", "lists", "confidence", F.explode("lists").alias("list")).withColumn("first", F.array_min("list"))
    weight = spread.groupBy("first").agg(F.count("*").alias("n"))
    best = spread.join(weight, "first").groupBy("antecedent", "lists", "confidence").agg(F.min(F.struct("n", "list")).alias("least"))
    return best.select(F.explode("least.list").alias("token"), "lists", "confidence")


def filter_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence of every row.

    labelled: rows (page_id, url, bad). verdict is the listed rule's; else
    `block` if a mined rule fires, whose confidence is given, else `allow`. The
    index is broadcast if it has at most `BROADCAST_RULES` rows, else joined by
    token. A row is numbered as it is read and known by its number from there
    on, so rows of one id or url are dealt like others, and a row's tokens are
    reduced to one record before the only shuffle. A null url has no tokens and
    is allowed; repeated rows give repeated results; an empty table gives an
    empty result; without labels only listed rules block.
    """
    mined = mine(labelled, min_support, min_confidence)
    n_mined = mined.count()
    rows = split_url(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("row")))
    rows = rows.withColumn("listed", listed_rule(rules))
    if n_mined:
        index = checkpointed(inverted_index(mined))
        index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
        rows = rows.withColumn("tokens", url_tokens())
        number = F.array(F.concat(F.lit("#"), F.pmod("row", F.lit(4096))))  # no token, dealt evenly
        looked = F.when(F.col("listed").isNull() & (F.size("tokens") > 0), F.col("tokens")).otherwise(number)
        spread = rows.withColumn("token", F.explode(looked)).join(index, "token", "left")
        fires = F.when(F.forall("lists", lambda some: F.arrays_overlap(some, "tokens")), F.col("confidence"))
        kept = [F.first(c).alias(c) for c in ("page_id", "host", "path", "listed")]
        rows = spread.groupBy("row").agg(*kept, F.max(fires).alias("confidence"))
    else:
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), "confidence")
