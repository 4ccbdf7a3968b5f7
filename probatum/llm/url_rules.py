"""URL filters: stated host and path rules, and association rules mined from the urls that those label.

A url has the host between its first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased, and the path from there to ``?``, ``#`` or
end. The longest stated rule that fits decides. Where none fits, mined rules do: urls that a stated rule labels
become baskets of their tokens (every label of the host, every segment of the path, its depth) and their verdict, FP-growth finds the frequent
baskets, and rules ``tokens -> verdict`` with enough urls and confidence stay. Tokens that the same labelled urls hold are one item, which a url
has if it has one of them: rules on any of them are alike. A mined rule lies in an inverted index under its
least frequent item, so a url meets only rules that share that item. The most confident, then most supported, then longest rule that
fits decides; a url that none fits is allowed.

Null urls and urls without ``://`` have empty host and path; no rule fits them, so they are allowed. Repeated rows get a row each.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import durable

STATED = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
LABEL = "verdict="
MIN_COUNT = 20  # labelled urls that a mined rule needs, whatever the size of the table


def host_of(url: str | Column) -> Column:
    text = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules=STATED) -> Column:
    """(verdict, rule) of the longest stated rule that fits, or null."""
    tests = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = (host == name) | host.endswith(f".{name}")
        tests.append(F.when(fits & path.startswith("/" + rest), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*tests)


def tokens_of(host: Column, path: Column) -> Column:
    """The tokens of a url: each host label by its place from the end, each path segment by its place, the depth of the path."""
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda s: s != "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def placed(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda s, i: F.concat(F.lit(kind), i.cast("string"), F.lit("="), s))

    depth = F.when(host != "", F.concat(F.lit("depth="), F.size(segments).cast("string")))
    return F.array_compact(F.concat(placed("host", labels), placed("path", segments), F.array(depth)))


def items_of(labelled: DataFrame, min_count: int) -> DataFrame:
    """(token, item, urls): the tokens of at least ``min_count`` labelled urls. Tokens that the same urls hold share an item, the first of them."""
    kinds = labelled.groupBy("tokens").count()
    vectors = kinds.select(F.explode("tokens").alias("token"), "count", F.xxhash64("tokens").alias("mark")).groupBy("token").agg(
        F.sum("count").alias("urls"), F.bit_xor("mark").alias("mark"), F.count("*").alias("kinds")).where(F.col("urls") >= min_count)
    alike = vectors.groupBy("urls", "mark", "kinds").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return alike.select(F.explode("tokens").alias("token"), "item", "urls")


def with_items(kinds: DataFrame, items: DataFrame) -> DataFrame:
    """(tokens, items) of distinct ``tokens``; those without a frequent token are left out."""
    return (kinds.select("tokens", F.explode("tokens").alias("token")).join(items, "token")
            .groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items")))


def mine_rules(labelled: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = 0.8) -> DataFrame:
    """(items, verdict, confidence, support) from rows of (items, verdict). ``support`` is a number of rows, as ``min_count`` is.

    Only frequent items are in the baskets; no basket is cut.
    """
    empty = labelled.sparkSession.createDataFrame([], "items array<string>, verdict string, confidence double, support long")
    rows = labelled.count()
    if rows < min_count:
        return empty
    baskets = labelled.select(F.concat("items", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / rows, minConfidence=min_confidence).fit(baskets)  # FP-growth rounds up
    sets = model.freqItemsets.withColumn("verdict", F.try_element_at(F.filter("items", lambda t: t.startswith(LABEL)), F.lit(1))).withColumn(
        "items", F.array_sort(F.filter("items", lambda t: ~t.startswith(LABEL))))
    whole = sets.where("verdict is null").select("items", F.col("freq").alias("all"))
    return (sets.where("verdict is not null and size(items) > 0").join(whole, "items")
            .select("items", F.expr(f"substring(verdict, {len(LABEL) + 1})").alias("verdict"), (F.col("freq") / F.col("all")).alias("confidence"),
                    F.col("freq").alias("support")).where(F.col("confidence") >= min_confidence))


def indexed(rules: DataFrame, items: DataFrame) -> DataFrame:
    """The rules with the item under which each is found: the one that fewest labelled urls have."""
    weight = items.select("item", "urls").distinct()
    named = rules.withColumn("rule_id", F.concat_ws(" ", F.concat_ws(" & ", "items"), F.lit("->"), "verdict"))
    rare = (named.select("rule_id", F.explode("items").alias("item")).join(weight, "item")
            .groupBy("rule_id").agg(F.min_by("item", F.struct("urls", "item")).alias("item")))
    return named.join(rare, "rule_id")


def judge_urls(pages: DataFrame, rules=STATED, min_count: int = MIN_COUNT, min_confidence: float = 0.8) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, mined) per row of ``pages``; ``mined`` names the association rule that decided."""
    urls = pages.select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path"))
    urls = urls.withColumn("stated", stated_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    labelled = urls.where("stated is not null").select("tokens", F.col("stated.verdict").alias("verdict"))
    items = durable(items_of(labelled, min_count), "url-items")
    # urls alike in tokens are judged once
    open_kinds = durable(with_items(urls.where("stated is null and size(tokens) > 0").select("tokens").distinct(), items), "url-kinds")
    known = with_items(labelled.select("tokens").distinct(), items).withColumnRenamed("tokens", "kind")
    baskets = durable(labelled.join(known, F.col("tokens") == F.col("kind")).select("items", "verdict"), "url-baskets")
    mined = indexed(mine_rules(baskets, min_count, min_confidence), items).select(
        "item", F.col("items").alias("needs"), F.struct("confidence", "support", F.size("items").alias("length"), "rule_id", "verdict").alias("found"))
    # urls alike in items meet the rules once
    best = (open_kinds.select("items").distinct().withColumn("item", F.explode("items")).join(mined, "item")
            .where(F.size(F.array_except("needs", "items")) == 0)
            .groupBy("items").agg(F.max("found").alias("found")))
    by_tokens = open_kinds.join(best, "items").select(F.col("tokens").alias("kind"), "found")
    judged = urls.join(by_tokens, F.col("tokens") == F.col("kind"), "left")
    by_rule = F.col("stated").isNotNull()
    return judged.select("page_id", "url", "host", "path", F.col("stated.rule").alias("rule"),
                         F.coalesce("stated.verdict", "found.verdict", F.lit("allow")).alias("verdict"),
                         F.when(~by_rule, F.col("found.rule_id")).alias("mined"))
