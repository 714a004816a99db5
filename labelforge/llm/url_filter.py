"""URL filter: a list of host and path rules, and beyond it a character
language-model ratio, in DataFrame operations.

URLs that a rule allows or blocks train two variable-order Markov models
(accepted, rejected).  An order-k probability mixes the count after the last k
characters with the order k-1 probability (Dirichlet weight ``mu``), so an
unseen context falls back to a shorter one.  A URL's score is the mean log
ratio per character of host + path; the threshold is calibrated on the
rule-judged URLs to the least sum of both error shares.

Character counts come from all distinct URLs that a rule judges, the calibration
counts their rows; every table is keyed by character n-gram, its
counts are combined before shuffling, and URLs are scored by a join of their
n-grams with the table of log ratios.

Edge cases: null urls and urls without ``://`` have empty host and path, fit no
rule and score 0; an empty text's verdict is ``allow`` if 0 reaches the
threshold; with no rejected or no accepted URL the threshold is minus infinity
(all allowed); repeated rows get equal verdicts; columns other than page_id and
url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import stage

#: (action, host, path) of the rule list.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4
MU = 4.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PAD = "\x02"
_BINS = 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the contract cuts them."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(action, rule) of the longest rule that fits, or null."""
    out = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def grams(rows: DataFrame, order: int) -> DataFrame:
    """(tid, label, gram): for each character its gram with ``order`` before."""
    padded = F.concat(F.lit(_PAD * order), "text")
    return rows.where(F.length("text") > 0).select(
        "tid", "label", padded.alias("p"), F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i")
    ).select("tid", "label", F.expr(f"substring(p, i, {order + 1})").alias("gram"))


def log_ratios(counts: DataFrame, order: int = ORDER, mu: float = MU) -> DataFrame:
    """(gram, llr) for every gram of full order, from (gram, a, r) counts."""
    alphabet = counts.groupBy(F.substring("gram", order + 1, 1).alias("gram")).agg(
        F.sum("a").alias("a"), F.sum("r").alias("r"))
    totals = alphabet.agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"), F.count(F.lit(1)).alias("v"))
    # One row of totals.
    table = alphabet.join(F.broadcast(totals)).select(
        "gram", *[((F.col(c) + 1.0) / (F.col("t" + c) + F.col("v"))).alias("p" + c) for c in "ar"])
    for k in range(1, order + 1):
        level = counts.groupBy(F.expr(f"substring(gram, {order + 1 - k}, {k + 1})").alias("gram")).agg(
            F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = Window.partitionBy(F.expr(f"substring(gram, 1, {k})"))
        level = (level.withColumn("ca", F.sum("a").over(context)).withColumn("cr", F.sum("r").over(context))
                 .withColumn("back", F.expr(f"substring(gram, 2, {k})")))
        shorter = table.select(F.col("gram").alias("back"), F.col("pa").alias("ba"), F.col("pr").alias("br"))
        table = level.join(shorter, "back").select(
            "gram", *[((F.col(c) + mu * F.col("b" + c)) / (F.col("c" + c) + mu)).alias("p" + c) for c in "ar"])
    return table.select("gram", F.log(F.col("pa") / F.col("pr")).alias("llr"))


def threshold(scores: DataFrame) -> float:
    """The cut with the least sum of both error shares, from a histogram of
    fixed width over the labelled scores (weighted by rows)."""
    cell = F.least(F.greatest(F.floor((F.col("score") + 8) / 16 * _BINS), F.lit(0)), F.lit(_BINS - 1))
    rows = scores.where("label is not null").groupBy(cell.alias("cell")).agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("r")).orderBy("cell").collect()  # <= _BINS rows
    accepted, rejected = sum(x["a"] for x in rows), sum(x["r"] for x in rows)
    if not accepted or not rejected:
        return float("-inf")
    best, cut, lost, caught = 1.0, float("-inf"), 0, 0
    for x in rows:
        lost, caught = lost + x["a"], caught + x["r"]
        error = lost / accepted + (rejected - caught) / rejected
        if error < best:
            best, cut = error, (x["cell"] + 1) / _BINS * 16 - 8
    return cut


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, mu: float = MU) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score (mean log ratio)."""
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = cut.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)) \
        .withColumn("tid", F.xxhash64(F.concat("host", "path")))
    label = F.when(F.col("r.action") == "allow", 1).when(F.col("r.action") == "block", 0)
    # Equal texts get equal grams and scores: each distinct one is cut up once.
    distinct = stage(ruled.groupBy("tid", F.concat("host", "path").alias("text"), label.alias("label"))
                     .agg(F.count(F.lit(1)).alias("n")), "urls")
    cutup = grams(distinct, order)
    counts = cutup.groupBy("gram").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("a"),
                                       F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("r"))
    ratios = log_ratios(stage(counts, "url-grams"), order, mu)
    scored = cutup.select("tid", "gram").join(ratios, "gram").groupBy("tid").agg(F.avg("llr").alias("llr"))
    scored = stage(distinct.join(scored, "tid", "left").select(
        "tid", "label", "n", F.round(F.coalesce("llr", F.lit(0.0)), 9).alias("score")), "url-scores")
    at = threshold(scored)
    return ruled.join(scored.select("tid", "score"), "tid").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.action", F.when(F.col("score") >= at, "allow").otherwise("block")).alias("verdict"), "score")
