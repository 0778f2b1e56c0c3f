"""URL filters: fixed allow and block prefixes, and association rules mined from labelled URLs.

Tokens that stand in exactly the same labelled URLs are one item; single items are counted directly. An item that only bad URLs
have is a rule that no larger one can beat, and an item that all URLs have adds nothing to a combination: neither takes part
in combinations, which loses none that would be kept. Spark's FP-growth finds the other item sets that are frequent
among bad URLs; each is then counted over all labelled URLs. Rules "items -> bad" are kept if they are common and if the
lower end of their confidence's interval is high; a rule whose items include those of a kept, no weaker rule goes.
The rules that remain are matched by an inverted index on each rule's rarest token, so a URL meets only rules of which it has
that token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

#: (host, path, verdict); a rule fits a host and its subdomains. The longest that fits wins.
PREFIX_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BAD = "=bad"
MIN_SUPPORT = 0.001
MIN_ROWS = 10
MIN_CONFIDENCE = 0.6
#: A longer token is its beginning and a hash of the whole.
TOKEN_CHARS = 64


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both are empty for a null or a text without ://."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def prefix_rule(host: Column, path: Column, rules=PREFIX_RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels, words of those with hyphens, path words, and names of query parameters.

    Tokens carry where they stand (h:, w:, p:, q:). Numbers are one token each for path and query, else every page
    number would be an item.
    """
    part = lambda text, sep: F.filter(F.split(text, sep), lambda x: x != "")
    short = lambda x: F.when(F.length(x) <= TOKEN_CHARS, x).otherwise(
        F.concat(F.substring(x, 1, TOKEN_CHARS - 17), F.lit("~"), F.lower(F.lpad(F.hex(F.xxhash64(x)), 16, "0")))
    )
    plain = lambda tag: (lambda x: F.concat(F.lit(tag), F.when(x.rlike("^[0-9]+$"), "0").otherwise(short(x))))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(part(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    hyphened = F.filter(part(host, r"\."), lambda x: x.contains("-"))
    return F.array_distinct(
        F.concat(
            F.transform(part(host, r"\."), plain("h:")),
            F.transform(F.filter(F.flatten(F.transform(hyphened, lambda x: part(x, "-"))), lambda x: ~x.rlike("^[0-9]+$")), plain("w:")),
            F.transform(part(F.lower(path), r"[^\p{L}\p{N}]+"), plain("p:")),
            F.transform(names, plain("q:")),
        )
    )


def seeded(tokens: Column, seeds: tuple[str, ...]) -> Column:
    """Whether a host label, or a word of one, is a seed."""
    return F.arrays_overlap(tokens, F.array(*(F.lit(tag + x) for x in seeds for tag in ("h:", "w:")))) if seeds else F.lit(False)


def mine(labelled: DataFrame, tokens: str = "tokens", bad: str = "bad", min_support: float = MIN_SUPPORT,
         min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, max_tokens: int | None = None) -> DataFrame:
    """Rules (tokens, confidence, n_rows) from labelled token sets; bad is boolean, and a null label is left out.

    Every labelled row counts. An item set must be in min_support of them and in min_rows at least; the lower end of
    the 95 % Wilson interval of its confidence must reach min_confidence. Of tokens that stand in the same rows the
    smallest names the item (host words come first). Rules have any number of items; max_tokens, if given, is the largest that
    is wanted. An empty table gives no rules, and rows without tokens count but have no items.
    """
    spark = labelled.sparkSession
    schema = "tokens array<string>, confidence double, n_rows long"
    baskets = labelled.where(F.col(bad).isNotNull()).select(F.col(bad).alias("bad"), F.coalesce(F.col(tokens), F.array()).alias("items"))
    baskets = materialise(baskets.withColumn("row", F.monotonically_increasing_id()), "url-baskets")
    total, n_bad = baskets.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if not n_bad:
        return spark.createDataFrame([], schema)
    least = max(min_support * total, min_rows)
    # What a rule's bad rows must number: with fewer, no confidence reaches the bound.
    least_bad = least * min_confidence
    single = baskets.select("bad", "row", F.explode(F.array_distinct("items")).alias("token")).groupBy("token").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("bad").cast("long")).alias("n_bad"),
        F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"),
    )
    same = ["n_rows", "n_bad", "x", "y"]
    items = materialise(single.where(F.col("n_bad") >= least_bad).withColumn("item", F.min("token").over(Window.partitionBy(*same))), "url-items")
    if items.isEmpty():
        return spark.createDataFrame([], schema)
    reps = items.where("token = item").select(F.array("item").alias("tokens"), "n_rows", "n_bad")
    # Items in combinations: neither in bad rows alone (where such a set is common enough) nor in all rows.
    sure = (F.col("n_bad") == F.col("n_rows")) & (F.col("n_rows") >= least) & (_low(F.col("n_bad"), F.col("n_rows")) >= min_confidence)
    joining = materialise(items.where((F.col("token") == F.col("item")) & ~sure & (F.col("n_rows") < total)).select("item"), "url-joining")
    if joining.limit(2).count() < 2:
        # Nothing to combine: single items are all the sets there are, and none of them is part of another.
        return _good(reps, least, min_confidence)
    one = baskets.select("bad", "row", F.explode(F.array_distinct("items")).alias("item")).join(joining, "item")
    rows = materialise(one.groupBy("row", "bad").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1), "url-rows")
    bad_rows = rows.where("bad").select("items")
    n_mined = bad_rows.count()
    sets = reps
    if n_mined and n_mined >= least_bad:
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, least_bad / n_mined), minConfidence=1.0).fit(bad_rows).freqItemsets
        found = found.where((F.size("items") > 1) & (F.lit(max_tokens is None) | (F.size("items") <= (max_tokens or 0))))
        found = materialise(found.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n_bad")).withColumn("rule", F.monotonically_increasing_id()), "url-sets")
        counted = match(rows, found, "row", "items").groupBy("rule").agg(F.count("*").alias("n_rows")).join(found, "rule")
        sets = reps.unionByName(counted.select("tokens", "n_rows", "n_bad"))
    kept = materialise(_good(sets, least, min_confidence), "url-good")
    if kept.where(F.size("tokens") > 1).isEmpty():
        return kept
    kept = materialise(kept.withColumn("rule", F.monotonically_increasing_id()), "url-kept")
    # A rule goes if a smaller kept one with its tokens is as sure: each rule is matched like a URL against the rest.
    smaller = kept.select("rule", "tokens", F.col("confidence").alias("their_confidence"))
    covered = (
        match(kept.select(F.col("rule").alias("mine"), F.col("tokens").alias("items")), smaller, "mine", "items")
        .join(kept.select(F.col("rule").alias("mine"), "confidence"), "mine")
        .where((F.col("rule") != F.col("mine")) & (F.col("their_confidence") >= F.col("confidence")))
        .select(F.col("mine").alias("rule")).distinct()
    )
    return kept.join(covered, "rule", "left_anti").select("tokens", "confidence", "n_rows")


def _good(sets: DataFrame, least: float, min_confidence: float) -> DataFrame:
    good = sets.where((F.col("n_rows") >= least) & (_low(F.col("n_bad"), F.col("n_rows")) >= min_confidence))
    return good.select("tokens", (F.col("n_bad") / F.col("n_rows")).alias("confidence"), "n_rows")


def _low(n_bad: Column, n_rows: Column) -> Column:
    """The lower end of the 95 % Wilson interval of a share."""
    p, z = n_bad / n_rows, 1.96
    return (p + z * z / (2 * n_rows) - z * F.sqrt(p * (1 - p) / n_rows + z * z / (4 * n_rows * n_rows))) / (1 + z * z / n_rows)


def match(rows: DataFrame, rules: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, rule's columns) for each row and each rule all of whose tokens the row has.

    The index holds a rule under its rarest token only. Whether it is broadcast is left to Spark, which knows its size;
    beyond the limit the same join is a shuffle join whose hot tokens are split.
    """
    one = rules.withColumn("_token", F.explode("tokens"))
    rare = one.groupBy("_token").agg(F.count("*").alias("_n"))
    first = Window.partitionBy("rule").orderBy("_n", "_token")
    index = one.join(rare, "_token").withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_n")
    index = materialise(index.select("_token", "rule", *(c for c in rules.columns if c != "rule")), "url-index")
    spread = rows.select(key, F.col(tokens).alias("_have"), F.explode(tokens).alias("_token"))
    hit = spread.join(index, "_token").where(F.size(F.array_except("tokens", "_have")) == 0)
    return hit.select(key, *(c for c in index.columns if c != "_token"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id",
          min_confidence: float = MIN_CONFIDENCE, max_tokens: int | None = None, seeds: tuple[str, ...] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the strongest mined rule that fits, else null).

    `labels` gives (label_id, quality, toxic) of pages; bad means quality 0 or toxic 1, and labels of one page that
    differ count by the worst; a page whose host has one of the words `seeds`, if any are given, is bad as well. The verdict is the prefix rule's; without one, block
    where a mined rule fits, else allow. Null and malformed URLs have an empty host and path and are allowed. URLs of any length
    are read whole. Repeated page ids are judged by their own URL, and each row gives a row, also one with a null id (which has
    no label). An empty table of pages gives no rows, one of labels no mined rules. Other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"), F.coalesce(url_tokens(host, path, F.col("url")), F.array()).alias("tokens")
    )
    name, verdict = prefix_rule(F.col("host"), F.col("path"))
    base = materialise(base.withColumns({"rule": name, "given": verdict, "row": F.monotonically_increasing_id()}), "url-pages")
    worst = labels.groupBy(F.col(label_id).alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = base.join(worst, "page_id", "left").select("tokens", F.when(seeded(F.col("tokens"), seeds), True).otherwise(F.col("bad")).alias("bad"))
    rules = mine(judged, min_confidence=min_confidence, max_tokens=max_tokens)
    rules = rules.withColumn("rule", F.concat_ws(" ", "tokens"))
    open_rows = base.where("given is null").select("row", "tokens")
    best = match(open_rows, rules, "row", "tokens").groupBy("row").agg(F.max_by("rule", F.struct("confidence", "rule")).alias("mined"))
    return base.join(best, "row", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("given", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined",
    )
