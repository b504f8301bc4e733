"""URL filter: ratio of character language models (operator 4).

Rules judge a part of the urls outright. Two smoothed variable-order Markov models, one of the allowed and one of the
blocked urls among these, judge the rest: a url's score is the difference of its log-likelihoods per character, and the
threshold is calibrated on a held-out tenth of the ruled urls, the models being counted on the other nine.

A character's probability blends orders 0 to 6, each order giving the next lower one the weight of its distinct followers
against its count (Witten-Bell); an unseen context thus falls back to a shorter one. Counts are exact and stay in a table
that grows with the ruled urls. From them each seen n-gram gets the difference of its two log-probabilities, and each seen
context the difference that falling back from it adds; both come from one join of n-grams with their own suffixes. Urls are
taken apart into the longest n-grams at their characters; the distinct ones are looked up, through their suffixes, by a join,
and their differences are joined to the characters and summed by url. Nothing is gathered on the driver or broadcast but the
histogram of the threshold.

Defined results: a null url, or one without `://`, has empty host and path, no rule, and the verdict of an empty text (score
0 against the threshold); ties with the threshold are allowed; among rules of one length the first listed wins; without
ruled urls of both sorts every unruled url is allowed; repeated rows count and are judged as often as they occur; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, require, written

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Characters of the longest n-gram.
ORDERS = 7
#: One over the number of characters that order 0 falls back to.
UNIFORM = 1 / 256
HOLD_OUT = 10
_START = "\u0002"


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (allow, block or null). Native."""
    url = F.col("url")
    scheme = F.instr(url, "://")
    rest = F.when(scheme > 0, F.substr(url, scheme + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    out = require(pages, "page_id", "url").withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the shortest first: each longer rule that fits takes over
    for name, what in sorted(reversed(rules), key=lambda r: len(r[0])):
        h, slash, p = name.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


def _text(url: Column) -> Column:
    """What the models read: the url in lower case, after the scheme, with start marks before it."""
    return F.concat(F.lit(_START * (ORDERS - 1)), F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", "")))


def _ended(t: str, i: Column, k) -> Column:
    """The k characters of t up to place i."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.substr(F.col(t), i - k + F.lit(1), k)


def count_grams(ruled: DataFrame) -> DataFrame:
    """gram, n0, n1: how often each n-gram of up to ORDERS characters stands in allowed and in blocked urls."""
    grams = F.flatten(F.transform(F.sequence(F.lit(ORDERS), F.length("t")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(ORDERS)), lambda k: _ended("t", i, k))))
    read = ruled.select("ruled", _text(F.col("url")).alias("t")).where(F.length("t") >= ORDERS)
    # common n-grams are added up before they are shuffled
    return read.select("ruled", F.explode(grams).alias("gram")).groupBy("gram").agg(F.count_if(F.col("ruled") == "allow").alias("n0"), F.count_if(F.col("ruled") == "block").alias("n1"))


def _shorter(gram: str) -> Column:
    """The n-gram's suffixes, itself first, with their lengths."""
    n = F.length(gram)
    return F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.struct(k.alias("k"), F.substr(F.col(gram), n - k + F.lit(1), k).alias("tail")))


def fitted(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gram, gain: difference of the two models' log-probabilities of its last character; context, back: what unseen followers add."""
    context = F.expr("substring(gram, 1, length(gram) - 1)")
    stats = [F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count_if(F.col("n0") > 0).alias("f0"), F.count_if(F.col("n1") > 0).alias("f1")]
    contexts = cut_lineage(counted.groupBy(context.alias("context")).agg(*stats))
    lost = lambda c: F.when(F.col(f"t{c}") > 0, F.log(F.col(f"f{c}") / (F.col(f"t{c}") + F.col(f"f{c}")))).otherwise(F.lit(0.0))
    back = contexts.select("context", (lost(0) - lost(1)).alias("back"))
    held = written(counted.withColumn("context", context).join(contexts, "context").drop("context"))
    # every suffix of a seen n-gram is seen, at the same places
    parts = held.select("gram", F.explode(_shorter("gram")).alias("s")).select("gram", "s.k", "s.tail").join(held.withColumnRenamed("gram", "tail"), "tail")
    orders = parts.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", "n0", "t0", "f0", "n1", "t1", "f1"))).alias("o"))  # ORDERS at most

    def blended(c: int) -> Column:
        step = lambda p, x: F.when(x[f"t{c}"] > 0, (x[f"n{c}"] + x[f"f{c}"] * p) / (x[f"t{c}"] + x[f"f{c}"])).otherwise(p)
        return F.aggregate("o", F.lit(UNIFORM), step)

    return written(orders.select("gram", (F.log(blended(0)) - F.log(blended(1))).alias("gain"))), cut_lineage(back)


def scorer(counted: DataFrame):
    """A function that adds `score` to a frame with `url`, from count_grams' result, and each model's number of characters."""
    counted = written(counted)
    chars = counted.where(F.length("gram") == 1).agg(F.sum("n0"), F.sum("n1")).first()
    gains, backs = fitted(counted)

    def of_grams(grams: DataFrame) -> DataFrame:
        """gram, gain of distinct n-grams of ORDERS characters: that of the longest seen suffix, and what led down to it."""
        parts = grams.select("gram", F.explode(_shorter("gram")).alias("s")).select("gram", "s.k", "s.tail").withColumn("context", F.expr("substring(tail, 1, length(tail) - 1)"))
        known = parts.join(gains.withColumnRenamed("gram", "tail"), "tail", "left").join(backs, "context", "left")
        listed = known.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", "gain", "back")), asc=False).alias("o"))
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("done"))
        step = lambda a, x: F.when(a["done"], a).otherwise(F.struct((a["sum"] + F.coalesce(x["gain"], x["back"], F.lit(0.0))).alias("sum"), x["gain"].isNotNull().alias("done")))
        return listed.select("gram", F.aggregate("o", zero, step)["sum"].alias("gain"))

    def score(urls: DataFrame) -> DataFrame:
        each = cut_lineage(urls.select("url").where("url IS NOT NULL").distinct().withColumn("number", F.monotonically_increasing_id()))
        read = each.select("number", _text(F.col("url")).alias("t")).where(F.length("t") >= ORDERS)
        at = F.transform(F.sequence(F.lit(ORDERS), F.length("t")), lambda i: _ended("t", i, ORDERS))
        places = read.select("number", F.explode(at).alias("gram"))
        # distinct n-grams are looked up once; a common one's side of the join back is split, both sides coming from a shuffle
        known = cut_lineage(of_grams(places.select("gram").distinct()))
        sums = places.join(known, "gram").groupBy("number").agg((F.sum("gain") / F.count(F.lit(1))).alias("score"))
        scored = cut_lineage(each.join(sums, "number", "left").select(F.col("url").alias("_url"), F.coalesce("score", F.lit(0.0)).alias("score")))
        kept = [c for c in urls.columns if c != "url"]
        return urls.join(scored, F.col("url") == F.col("_url"), "left").select(*kept, F.coalesce("score", F.lit(0.0)).alias("score"))

    return score, chars[0] or 0, chars[1] or 0


def threshold(scored: DataFrame) -> float:
    """The score with the best balanced accuracy on ruled, scored urls; found on a histogram of fixed size."""
    bins = scored.select("ruled", F.floor(F.greatest(F.least("score", F.lit(8.0)), F.lit(-8.0)) * 64).alias("bin")).groupBy("bin").agg(
        F.sum((F.col("ruled") == "allow").cast("long")).alias("a"), F.sum((F.col("ruled") == "block").cast("long")).alias("b")
    )
    rows = sorted((r["bin"], r["a"], r["b"]) for r in bins.collect())
    allow, block = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allow or not block:
        return 0.0
    best, cut, below_a, below_b = 0.5, rows[0][0], 0, 0
    for at, a, b in rows:
        if (quality := ((allow - below_a) / allow + below_b / block) / 2) > best:
            best, cut = quality, at
        below_a, below_b = below_a + a, below_b + b
    return cut / 64


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)."""
    ruled = with_rules(pages, rules)
    labelled = ruled.where("ruled IS NOT NULL")
    held = F.pmod(F.xxhash64("page_id", "url"), F.lit(HOLD_OUT)) == 0
    score, allowed, blocked = scorer(count_grams(labelled.where(~held)))
    if not allowed or not blocked:
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    cut = threshold(score(labelled.where(held).select("ruled", "url")))
    # only unruled urls meet the models; the others skip Python
    free = score(ruled.where("ruled IS NULL").select("page_id", "host", "path", "rule", "url"))
    free = free.withColumn("verdict", F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block")))
    cols = ["page_id", "host", "path", "rule", "verdict", "score"]
    return labelled.withColumn("verdict", F.col("ruled")).withColumn("score", F.lit(None).cast("double")).select(cols).unionByName(free.select(cols))
