"""URL filters: host and path rules first, then association rules from labels.

Spark's FP-growth mines combinations of URL tokens among labelled URLs to be
blocked; their counts over all labelled URLs give confidence and lift, by which
with support they are pruned.  Tokens that always occur together are one item,
and those that every URL has are none, so a URL template doesn't multiply its
combinations.  A longer rule that is no more confident than a shorter one inside
it is dropped.  A rule is indexed under its rarest token, so a URL meets only
rules whose rarest token it has, and then must have the rest.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import materialize

#: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Share of labelled URLs that a rule blocks rightly, that of those it meets, and how often that is the share among all.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.5, 2.0
#: A rule blocks at least so many labelled URLs rightly, however few there are.
LEAST_ROWS = 20
#: An index of at most so many rules is broadcast; a larger one is joined by shuffling.
BROADCAST_RULES = 50_000
RULE_SCHEMA = "rule string, tokens array<string>, confidence double, support double"


def host_of(url: str) -> Column:
    """The host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: str) -> Column:
    """Distinct tokens: labels of the host, words of the path and names of the query; numbers are one token."""
    scheme = F.regexp_extract(F.col(url), r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(F.col(url), r"(?s)\?([^#]*)", 1)
    named = lambda kind, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind), F.when(p.rlike(r"^\d+$"), F.lit("0")).otherwise(p)))
    parts = [named("scheme:", F.array(scheme)), named("host:", F.split(host_of(url), r"[.\-:]")), named("path:", F.split(F.lower(path_of(url)), r"[/._\-]+")), named("query:", F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)))]
    return F.array_distinct(F.concat(*parts))


def _items(baskets: DataFrame, rows: int) -> DataFrame:
    """(token, item): tokens that occur in the same baskets (id, tokens) are one item; those of all baskets are none."""
    seen = baskets.select("id", F.explode("tokens").alias("token")).groupBy("token")
    # Two sums of 64-bit hashes tell sets of baskets apart.
    sums = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)]
    marked = seen.agg(F.count("*").alias("n"), *sums).where(F.col("n") < rows)
    least = marked.groupBy("n", "s0", "s1").agg(F.min("token").alias("item"))
    return marked.join(least, ["n", "s0", "s1"]).select("token", "item")


def mine(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules (rule, tokens, confidence, support) from rows (url, blocked), without redundant ones.

    Null urls and labels are left out; without rows there are no rules. Support
    is the share of rows that have the tokens and are blocked. Repeated rows
    count each.
    """
    spark = urls.sparkSession
    labelled = urls.where("url is not null and blocked is not null").select(F.monotonically_increasing_id().alias("id"), "blocked", tokens_of("url").alias("tokens"))
    labelled = materialize(labelled)
    rows, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col("blocked").cast("int")), F.lit(0))).first()
    if not blocked:
        return spark.createDataFrame([], RULE_SCHEMA)
    items = materialize(_items(labelled, rows))
    single = labelled.select("id", "blocked", F.explode("tokens").alias("token")).join(items, "token").where("token = item")
    baskets = materialize(single.groupBy("id", "blocked").agg(F.collect_list("item").alias("items")))
    least = max(min_support * rows, LEAST_ROWS)
    if blocked < least:
        return spark.createDataFrame([], RULE_SCHEMA)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / blocked)).fit(baskets.where("blocked"))
    found = model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("right"))
    found = materialize(found.select(F.array_join("tokens", " ").alias("rule"), "tokens", "right"))
    met = _met(baskets.select(F.col("id").alias("at"), F.col("items").alias("tokens")), found).groupBy("rule").agg(F.count("*").alias("n"))
    share = F.col("right") / F.col("n")
    rules = found.join(met, "rule").where((share >= min_confidence) & (share >= min_lift * blocked / rows))
    return _irredundant(materialize(rules.select("rule", "tokens", share.alias("confidence"), (F.col("right") / rows).alias("support"))))


def _irredundant(rules: DataFrame) -> DataFrame:
    """``rules`` without those that have a shorter rule of no less confidence inside them.

    Rules of one length after another drop the longer ones: what drops a
    rule that is itself dropped drops the same, so only rules that stay are held
    against others, each under the token that the fewest rules have.
    """
    lengths = sorted(r.n for r in rules.select(F.size("tokens").alias("n")).distinct().collect())
    for n in lengths[:-1]:
        token = rules.select("rule", "tokens", "confidence", F.explode("tokens").alias("token"))
        often = token.groupBy("token").agg(F.count("*").alias("often"))
        short = token.where(F.size("tokens") == n).join(often, "token").groupBy("rule").agg(F.min(F.struct("often", "token"))["token"].alias("token"), F.first("tokens").alias("inner_tokens"), F.first("confidence").alias("inner_confidence")).drop("rule")
        redundant = token.where(F.size("tokens") > n).join(short, "token").where((F.col("inner_confidence") >= F.col("confidence")) & (F.size(F.array_except("inner_tokens", "tokens")) == 0))
        rules = materialize(rules.join(redundant.select("rule").distinct(), "rule", "left_anti"))
    return rules


def _met(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(at, rule) of the rows (at, tokens) that have all tokens of a rule, by an index of each rule's rarest token."""
    posted = rows.select("at", "tokens", F.explode("tokens").alias("token"))
    needed = rules.select("rule", "tokens", F.explode("tokens").alias("token"))
    small = rules.count() <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda x: x)
    frequency = posted.select("token").join(hint(needed.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("often"))
    ranked = needed.join(frequency, "token", "left")
    rarest = F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token"))["token"]
    index = ranked.groupBy("rule").agg(rarest.alias("token"), F.first("tokens").alias("wanted"))
    return posted.join(hint(index), "token").where(F.size(F.array_except("wanted", "tokens")) == 0).select("at", "rule")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that have all tokens of some rule, with the number of such rules."""
    tokens = materialize(urls.where("url is not null").select("url").distinct().select(F.col("url").alias("at"), tokens_of("url").alias("tokens")))
    return _met(tokens, rules).groupBy(F.col("at").alias("url")).agg(F.count("*").alias("n_rules"))


def by_rules(host: str, path: str, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; null where none does. The list is part of the query."""
    hit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == name) | F.col(host).endswith(f".{name}")) & F.col(path).startswith(start)
        hit = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(hit)
    return hit


def url_verdicts(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and n_rules (association rules met) for every row of ``pages``.

    ``labelled`` has rows (url, blocked), from which association rules are
    mined. A null url, or one without ``://``, has an empty host and path;
    without a rule and tokens it is allowed. Repeated rows are judged each, and
    further columns are not read. No rows give none.
    """
    pages = pages.select("page_id", "url")
    found = matches(pages, mine(labelled)).withColumnRenamed("url", "found_url")
    judged = pages.join(found, F.col("url") == F.col("found_url"), "left").select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules")).withColumn("hit", by_rules("host", "path", rules))
    learned = F.when(F.col("n_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", learned).alias("verdict"), "n_rules")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of the pages that show a labelled document: blocked if its quality is 0.

    A page's path is its language and the number of the document that it shows,
    so that is the key of its label. Labels that repeat or contradict each
    other count once, as quality 1 if any says so; null ones don't count.
    """
    number = F.regexp_extract(path_of("url"), r"^/[a-z]{2}/(\d{1,18})(?:\D|$)", 1)
    shown = pages.select("url", F.when(number != "", number).cast("long").alias("doc"))
    poor = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg((F.max("quality") == 0).alias("blocked"))
    return shown.join(poor, "doc").select("url", "blocked")
