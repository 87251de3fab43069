"""URL filtering by association rules.

Explicit rules (host, path) judge the urls they fit, and these verdicts are the
labels from which Spark's FP-growth mines which combinations of url tokens mean
allow or block. Tokens that always come together are one item, and tokens that
decide alone are rules before mining starts. Rules below the confidence or support wanted, and rules that a
shorter one makes redundant, are pruned; the rest match other urls by an
inverted index from token to rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .shared import partitions, settled, veiled

#: (verdict, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.7
DEFAULT = "allow"
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule fits its
    host and all subdomains if the path starts with the rule's."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: registered domain, top-level domain, the
    labels before them, path segments by place, ending, names of query
    parameters. Tokens say different things: what another token implies (a
    label of the domain, the number of segments) is none."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    named = lambda prefix, items: F.transform(items, lambda x: F.concat(F.lit(prefix), x))
    tokens = F.concat(
        F.array(
            F.when(n > 1, F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.greatest(F.lit(1), n - 1), 2), "."))),
            F.when(n > 0, F.concat(F.lit("top:"), F.element_at(labels, -1))),
            F.concat(F.lit("ending:"), F.nullif(F.regexp_extract(path, r"\.([^./]*)\z", 1), F.lit(""))),
        ),
        named("label:", F.slice(labels, F.lit(1), F.greatest(F.lit(0), n - 2))),
        F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), x)),
        named("query:", F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.split(x, "=")[0])),
    )
    return F.array_distinct(F.array_compact(tokens))


def token_kinds(labelled: DataFrame, least: int) -> DataFrame:
    """item, members, n, verdict, hits over ``labelled`` (tokens, verdict): tokens
    that stand in just the same urls are one item, named by the first of them;
    n urls have it, hits of them with the verdict that most have. Only items
    with ``least`` hits are given: others are in no rule.

    A token's urls are told by two folds of their token sets' hashes, so no list
    of urls is made. Frequent tokens are at most a url's tokens times all urls
    over ``least``, whatever the number of urls.
    """
    sets = labelled.groupBy(F.array_sort("tokens").alias("tokens"), "verdict").agg(F.count(F.lit(1)).alias("n"))
    one = sets.select("verdict", "n", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit("second"), "tokens").alias("b"), F.explode("tokens").alias("token"))
    by_set = one.groupBy("token", "a", "b").agg(F.sum("n").alias("n"), F.sum(F.expr("IF(verdict = 'block', n, 0)")).alias("blocked"))
    found = by_set.groupBy("token").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    found = found.where(F.greatest("blocked", F.col("n") - F.col("blocked")) >= least)
    kinds = found.groupBy("a", "b", "n", "blocked").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members"))
    mostly = F.when(2 * F.col("blocked") > F.col("n"), "block").otherwise("allow")
    return settled(kinds.select("item", "members", "n", mostly.alias("verdict"), F.greatest("blocked", F.col("n") - F.col("blocked")).alias("hits")))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, tokens, verdict, confidence, support) from ``labelled``
    (tokens, verdict: allow or block), and (token, item): the item of
    ``token_kinds`` that each token of a rule stands for.

    A rule's tokens are items; any member of each will do. Of rules with one
    verdict, one stays only if no rule with fewer of its tokens is as confident.
    An item that all its urls give one verdict is a rule already and beats all
    that hold it, so FP-growth only sees the items that are left: tokens that
    many urls share wholly, or that decide alone, do not multiply.
    """
    total = labelled.count()
    least = -(-int(round(min_support * total * 1e6)) // 1_000_000)
    kinds = token_kinds(labelled, max(1, least))
    sure = F.col("hits") == F.col("n")
    alone = kinds.where(sure).select(F.array("item").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), (F.col("hits") / total).alias("support"))
    open_items = [r[0] for r in kinds.where(~sure).select("item").orderBy("item").collect()]  # frequent tokens: bounded, see token_kinds
    left = F.array_intersect("tokens", F.array(*map(F.lit, open_items)).cast("array<string>"))
    baskets = labelled.select(F.array_union(left, F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=partitions(labelled.sparkSession)).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    several = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 99).alias("verdict"), F.round("confidence", 9).alias("confidence"), "support")
    rules = settled(alone.where(F.col("support") >= min_support).unionByName(several))
    # a shorter rule shares a token, so candidates meet at their tokens
    one = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
    other = rules.select(F.col("tokens").alias("fewer"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"), F.element_at("tokens", 1).alias("token"))
    beaten = one.join(other, "token").where((F.col("verdict") == F.col("same")) & (F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0) & (F.col("sure") >= F.col("confidence")))
    kept = rules.join(beaten.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")
    kept = settled(kept.withColumn("rule_id", F.concat_ws(" ", F.array_join("tokens", " "), F.lit("=>"), F.col("verdict"))))
    used = kept.select(F.explode("tokens").alias("item")).distinct()
    return kept, settled(kinds.join(used, "item").select(F.explode("members").alias("token"), "item"))


def match_rules(token_sets: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """tokens, mined and mined_verdict: for each of the distinct ``token_sets``
    that some rule matches wholly, the most confident one (then the better
    supported, then the longer, then the first by name)."""
    index = rules.select(F.explode("tokens").alias("item"), "rule_id", F.size("tokens").alias("needs"))
    items = token_sets.select("tokens", F.explode("tokens").alias("token")).join(members, "token").select("tokens", "item").distinct()
    hits = items.join(index, "item").groupBy("tokens", "rule_id", "needs").agg(F.count(F.lit(1)).alias("has")).where("has = needs")
    full = hits.join(rules.drop("tokens"), "rule_id")
    best = full.groupBy("tokens").agg(F.min(F.struct(-F.col("confidence"), -F.col("support"), -F.col("needs"), "rule_id", "verdict")).alias("b"))
    return best.select("tokens", F.col("b.rule_id").alias("mined"), F.col("b.verdict").alias("mined_verdict"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule (the longest explicit rule that fits),
    mined (the mined rule that judged, only where rule is null) and verdict; html
    and url are left out.

    A null url or one without ``://`` has an empty host and path and is judged
    by the mined rules like any other; where none matches, ``default``. Repeated
    rows give repeated results; like-named columns are replaced. Where no url
    fits an explicit rule nothing is mined. An empty table gives an empty result.
    """
    own = ["host", "path", "rule", "mined", "verdict"]
    rest = [c for c in pages.columns if c not in [*own, "url", "html"]]
    shown, names, back = veiled(pages.select(*rest, "url"), rest)
    split = shown.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = split.withColumns({"rule": rule, "given": verdict, "tokens": url_tokens(F.col("url"), F.col("host"), F.col("path"))}).drop("url")
    labelled = judged.where("given IS NOT NULL").select("tokens", F.col("given").alias("verdict"))
    if labelled.isEmpty():
        return judged.select(*back, "host", "path", "rule", F.lit(None).cast("string").alias("mined"), F.coalesce("given", F.lit(default)).alias("verdict"))
    mined, members = mine_rules(labelled, min_support, min_confidence)
    # Only tokens that rules name matter; what is left of the urls has few distinct sets.
    # These are frequent tokens, so their number is bounded by token_kinds.
    known = [r[0] for r in members.select("token").distinct().orderBy("token").collect()]
    judged = judged.withColumn("tokens", F.array_sort(F.array_intersect("tokens", F.array(*map(F.lit, known)).cast("array<string>"))))
    sets = judged.where("rule IS NULL").select("tokens").distinct()
    # most urls may share one set of tokens, so both sides are dealt out by a salt as well
    salted = match_rules(sets, mined, members).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = judged.withColumn("salt", F.pmod(F.xxhash64(*names, "path"), F.lit(SALTS)).cast("int")).join(salted, ["tokens", "salt"], "left")
    unruled = F.col("rule").isNull()
    return out.select(*back, "host", "path", "rule", F.when(unruled, F.col("mined")).alias("mined"), F.coalesce("given", F.when(unruled, F.col("mined_verdict")), F.lit(default)).alias("verdict"))
