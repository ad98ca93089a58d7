"""URL verdicts: written rules first, then association rules over URL tokens."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .columns import UPPER, renamed

# The written rules (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BAD = "label=bad"
MIN_SUPPORT = 0.002
MIN_COUNT = 5
MIN_CONFIDENCE = 0.6
MAX_ITEMS = 12
BROADCAST_RULES = 10_000
SALTS = 16


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def written_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null where none fits.

    Longest is by characters of host and path; a rule fits its host and every subdomain.
    """
    ranked = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), reverse=True)
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(ranked):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(
            path, F.lit(rule_path)
        )
        out = F.when(
            fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(out)
    return out


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels, the words of labels with a hyphen, path words without numbers,
    query names, scheme."""
    labels = F.transform(F.split(host, "\\."), lambda x: F.concat(F.lit("host:"), x))
    hyphened = F.filter(F.split(host, "\\."), lambda x: F.contains(x, F.lit("-")))
    parts = F.transform(
        F.flatten(F.transform(hyphened, lambda x: F.split(x, "-"))),
        lambda x: F.concat(F.lit("word:"), x),
    )
    steps = F.transform(
        F.filter(F.split(path, "[/._-]"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")),
        lambda x: F.concat(F.lit("path:"), F.lower(x)),
    )
    query = F.transform(
        F.filter(
            F.split(F.regexp_extract(url, "\\?([^#]*)", 1), "&"), lambda x: x != ""
        ),
        lambda x: F.concat(F.lit("query:"), F.split(x, "=", 2)[0]),
    )
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(labels, parts, steps, query, scheme))
    )


def token_groups(labelled: DataFrame, min_count: int) -> DataFrame:
    """(token, item, held, bad) of tokens on at least ``min_count`` bad rows.

    Tokens that stand on the very same rows are one item, named after the first of them: no rule can
    tell them apart. The sets of rows are compared by count and 128 bits of hash.
    """
    held = labelled.select("row", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("held"), F.count_if("bad").alias("bad"),
        F.bit_xor(F.xxhash64("row")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("x2"),
    ).where(F.col("bad") >= min_count)
    return materialize(
        held.withColumn(
            "item", F.min("token").over(Window.partitionBy("held", "bad", "x1", "x2"))
        ).select("token", "item", "held", "bad"), "token-groups")


def _rules_inside(held: DataFrame, n_rows: int, n_bad: int, least: int, min_confidence: float) -> DataFrame:
    """Rules (tokens, confidence, support) of the item sets that a cut row has, counted over all rows.

    ``held`` is (row, bad, cut, item). A level's sets are made of two sets of the level before that stand on
    one row and differ in their last item. A set goes on while it has ``least`` bad rows and a cut one,
    fewer rows than any set with one item less, and a good row: what is left out has no rule, or none that
    a shorter rule does not give with the same confidence. Rows are not cut, levels go on until none is open.
    """
    counts = [F.count("*").alias("n"), F.count_if("bad").alias("b"), F.count_if("cut").alias("c")]
    wanted = (F.col("b") >= least) & (F.col("c") > 0)
    rows = held.select("row", "bad", "cut", F.array("item").alias("tokens"))
    sets = materialize(rows.groupBy("tokens").agg(*counts).where(wanted), "url-sets")
    found = []
    while True:
        share = F.col("b") / F.col("n")
        found.append(sets.where((share >= min_confidence) & (F.col("b") * n_rows > F.col("n") * n_bad)).select(
            "tokens", share.alias("confidence"), (F.col("b") / n_rows).alias("support")))
        opened = sets.where("b < n").select("tokens", F.col("n").alias("before"))
        rows = materialize(rows.join(opened.select("tokens"), "tokens", "left_semi"), "url-sets")
        if not rows.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        start = F.expr("slice(tokens, 1, size(tokens) - 1)")
        ends = rows.select("row", "bad", "cut", start.alias("start"), F.element_at("tokens", -1).alias("end"))
        longer = ends.join(
            ends.select("row", "start", F.col("end").alias("last")), ["row", "start"]).where("end < last")
        rows = longer.select("row", "bad", "cut", F.concat("start", F.array("end", "last")).alias("tokens"))
        tried = materialize(rows.groupBy("tokens").agg(*counts).where(wanted), "url-sets")
        shorter = tried.select("tokens", "n", F.explode("tokens").alias("out")).select(
            F.col("tokens").alias("whole"), "n", F.array_remove("tokens", F.col("out")).alias("tokens"))
        fewer = shorter.join(opened, "tokens").where("n < before").groupBy("whole").agg(F.count("*").alias("k"))
        fewer = fewer.where(F.col("k") == F.size("whole")).select(F.col("whole").alias("tokens"))
        sets = materialize(tried.join(fewer, "tokens", "left_semi"), "url-sets")


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_count: int = MIN_COUNT,
    max_items: int = MAX_ITEMS,
) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens, confidence, support) that imply a bad label, and the items' tokens (token, item).

    ``labelled`` is (tokens array<string>, bad boolean). Tokens that always stand together are one
    item, and a rule's ``tokens`` are items. FP-growth counts the item sets of items and label; a
    rule stays when it holds on at least ``min_count`` bad rows and a share ``min_support`` of all,
    when its confidence reaches the limit and beats the share of bad rows (lift above 1), and when
    no rule with fewer of its items is as confident.

    FP-growth counts every subset of a row, so it takes at most ``max_items`` items of one: those with the
    largest share of bad rows (then on most rows, then by name). The item sets of the rows that this cuts
    are counted over whole rows level by level (``_rules_inside``), so no rule is lost.
    """
    labelled = materialize(
        labelled.where(F.size("tokens") > 0).withColumn("row", F.monotonically_increasing_id()),
        "url-baskets")
    groups = token_groups(labelled, min_count)
    rank = F.struct(
        (-F.col("held_bad") / F.col("held")).alias("share"), (-F.col("held")).alias("rows"), "item")
    found = materialize(labelled.select("row", F.explode("tokens").alias("token")).join(
        groups.withColumnRenamed("bad", "held_bad"), "token"
    ).groupBy("row").agg(F.sort_array(F.collect_set(rank))["item"].alias("items")), "url-items")
    # Rows without a frequent token count as well: shares are of all labelled rows.
    none = F.array().cast("array<string>")
    baskets = labelled.join(found, "row", "left").select(
        F.concat(
            F.slice(F.coalesce("items", none), 1, max_items),
            F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(none)).alias("items"))
    n_rows = max(labelled.count(), 1)
    least = min(1.0, max(min_support, (min_count - 0.5) / n_rows))
    model = FPGrowth(
        itemsCol="items", minSupport=least,
        minConfidence=min_confidence,
        numPartitions=int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    ).fit(baskets)
    rules = materialize(
        model.associationRules
        .where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") > 1))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"),
        "url-rules",
    )
    cut = F.size("items") > max_items
    if found.where(cut).limit(1).count():
        held = materialize(labelled.select("row", "bad").join(found, "row").select(
            "row", "bad", cut.alias("cut"), F.explode("items").alias("item")), "url-held")
        inside = _rules_inside(held, n_rows, labelled.where("bad").count(), ceil(least * n_rows), min_confidence)
        # Counts of FP-growth hold for the sets that no cut row has.
        parts = rules.select("tokens", F.explode("tokens").alias("item")).join(held.where("cut"), "item")
        counted = parts.groupBy("tokens", "row").agg(F.count("*").alias("n")).where(F.col("n") == F.size("tokens"))
        rules = materialize(
            rules.join(counted.select("tokens").distinct(), "tokens", "left_anti").unionByName(inside), "url-rules")
    # A longer rule is redundant when dropping one of its items gives a rule as confident.
    shorter = rules.where(F.size("tokens") > 1).select(
        F.col("tokens").alias("whole"), F.col("confidence").alias("c"),
        F.explode("tokens").alias("out"),
    ).select("whole", "c", F.array_remove("whole", F.col("out")).alias("tokens"))
    redundant = shorter.join(rules, "tokens").where(F.col("confidence") >= F.col("c")).select(
        F.col("whole").alias("tokens")
    ).distinct()
    return rules.join(redundant, "tokens", "left_anti"), groups.select("token", "item")


def _with_items(pages: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(row_key, tokens): the items of the rules that a page has a token of."""
    used = rules.select(F.explode("tokens").alias("item")).distinct()
    named = items.join(used, "item")
    return pages.select("row_key", F.explode("tokens").alias("token")).join(named, "token").groupBy(
        "row_key").agg(F.collect_set("item").alias("tokens"))


def _matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(row_key, confidence) of the most confident rule whose items a page holds.

    Inverted index: a rule is posted under its rarest item only; the pages that hold the item
    are candidates, and the whole rule is checked in the row.
    """
    held = pages.select(F.explode("tokens").alias("token")).groupBy("token").count()
    posting = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(
        held, "token"
    )
    rarest = posting.groupBy("tokens", "confidence").agg(
        F.min(F.struct("count", "token")).alias("r")
    ).select(F.col("tokens").alias("rule_tokens"), "confidence", F.col("r.token").alias("token"))
    rarest = materialize(rarest, "url-index")
    keys = rarest.select("token").distinct()
    n_rules = rarest.count()
    postings = pages.select("row_key", "tokens", F.explode("tokens").alias("token"))
    if n_rules <= BROADCAST_RULES:
        postings = postings.join(F.broadcast(keys), "token", "left_semi")
        candidates = postings.join(F.broadcast(rarest), "token")
    else:
        # A frequent token's pages are dealt over salts; the few rules are repeated per salt.
        salted = rarest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        candidates = postings.withColumn(
            "salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int")
        ).join(salted, ["token", "salt"])
    fits = F.size(F.array_except("rule_tokens", "tokens")) == 0
    return candidates.where(fits).groupBy("row_key").agg(F.max("confidence").alias("confidence"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    label_id: str = "doc_id",
    written: Sequence[tuple[str, str, str]] = RULES,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_count: int = MIN_COUNT,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, confidence).

    The longest fitting written rule decides. Elsewhere the page is blocked when it holds a token of
    every item of a mined rule, ``confidence`` being that of the most confident one, and allowed
    otherwise. Rules are mined over all labelled pages (``labels.label_id`` names the page; bad is
    quality 0 or toxic 1; of several label rows one bad row makes a page bad).

    Verdicts are found per distinct URL, so repeated URLs cost one row.

    Defined cases: a null URL, or one without ``://``, has empty host and path, no tokens, and is
    allowed. Repeated and null page ids stay as rows; label rows with null ids or figures say
    nothing. Of a URL with more than ``max_items`` items all are searched, level by level; tokens on
    fewer than ``min_count`` bad pages make no rule. Without labelled pages there are no mined rules. An empty table gives no rows. Other
    columns are ignored.
    """
    base = renamed(pages, page_id=page_id, url=url)
    spark = base.sparkSession
    distinct = base.select("url").distinct()
    host, path = url_parts(F.col("url"))
    parsed = distinct.select("url", host.alias("host"), path.alias("path"))
    parsed = materialize(
        parsed.select(
            F.coalesce("url", F.lit("")).alias("row_key"), F.col("url").isNull().alias("is_null"),
            "host", "path", url_tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"),
            written_rule(F.col("host"), F.col("path"), written).alias("w"),
        ), "urls",
    )
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = renamed(labels, id=label_id, quality="quality", toxic="toxic").select(
        "id", bad.alias("bad")
    ).where("bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    labelled = base.join(marks, F.col("page_id") == F.col("id")).select(
        F.col("url").alias("row_key"), "bad"
    ).where("row_key is not null").join(parsed.where(~F.col("is_null")), "row_key")
    labelled = materialize(labelled.select("tokens", "bad"), "labelled-urls")
    best = parsed.select("row_key").limit(0).withColumn("confidence", F.lit(0.0))
    if labelled.where("bad").limit(1).count():
        open_pages = parsed.where(F.col("w").isNull() & (F.size("tokens") > 0))
        rules, items = mine_rules(labelled, min_support, min_confidence, min_count, max_items)
        rules = materialize(rules, "url-rules")
        best = _matched(materialize(_with_items(open_pages, rules, items), "url-items"), rules)
    judged = parsed.join(best, "row_key", "left").select(
        F.when(~F.col("is_null"), F.col("row_key")).alias("u"), "host", "path",
        F.col("w.rule").alias("rule"),
        F.coalesce(
            F.col("w.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
        ).alias("verdict"),
        F.when(F.col("w").isNull(), F.col("confidence")).alias("confidence"),
    )
    return base.join(judged, F.col("url").eqNullSafe(F.col("u"))).select(
        "page_id", "host", "path", "rule", "verdict", "confidence"
    )
