"""URL filter: rules by host and path, and a ratio of character models for all other urls.

Urls that a rule allows or blocks teach two variable-order Markov models, one of
accepted and one of rejected urls. The probability of a character mixes the counts
after its last four characters with the model of the next shorter context, down to
single characters. A url without rule is judged by the mean log ratio of its characters,
against a threshold calibrated on rule-judged urls that the models have not seen. All
of it is DataFrame work: counts of distinct grams are aggregated, the models of the
orders are joined to one another, and each distinct url sums the ratios of its grams.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lotline.llm.common import stored

ORDER = 4  # characters of the longest context
PRIOR = 2.0  # weight of the shorter context in counts
ALPHABET = 256.0  # a character never seen has this share
START, END = "\x02", "\x03"
URLS_PER_TASK = 10_000  # distinct urls that a task cuts into grams
FREQUENT = 10_000  # a gram is frequent from one in this many occurrences on, so at most this many are


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    found = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_rule(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits the host or a subdomain and starts the path."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: len(rule.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def _grams(url: Column) -> Column:
    """The last ``ORDER`` + 1 characters at each character of a url and at its end."""
    padded = F.concat(F.array_repeat(F.lit(START), ORDER), F.split(url, ""), F.array(F.lit(END)))

    def cut(chars: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(chars) - ORDER)
        return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, F.lit(ORDER + 1)), ""))

    # Bound to a name of its own, the list of characters is made once and not for every gram.
    return F.flatten(F.transform(F.array(F.filter(padded, lambda c: c != "")), cut))


def _model(grams: DataFrame) -> DataFrame:
    """``gram, ratio``: log probability of the last character after the others, accepted against rejected.

    ``grams`` has ``gram, accepted, rejected`` (counts), a row per gram that occurs anywhere.
    """
    sides = ("accepted", "rejected")
    lower = None
    for size in range(1, ORDER + 2):
        counts = grams.groupBy(F.right("gram", F.lit(size)).alias("gram")).agg(*(F.sum(s).alias(s) for s in sides))
        if size == 1:
            total = counts.agg(*(F.sum(s).alias(s) for s in sides)).first()  # one row
            known = counts.select(
                "gram", *((F.col(s) + PRIOR / ALPHABET) / ((total[s] or 0) + PRIOR) for s in sides)
            ).toDF("gram", *(f"p_{s}" for s in sides))
        else:
            context = F.left("gram", F.lit(size - 1))
            totals = counts.groupBy(context.alias("context")).agg(*(F.sum(s).alias(f"n_{s}") for s in sides))
            joined = counts.withColumn("context", context).withColumn("shorter", F.right("gram", F.lit(size - 1)))
            joined = joined.join(totals, "context").join(lower.withColumnRenamed("gram", "shorter"), "shorter")
            known = joined.select(
                "gram",
                *(
                    ((F.col(s) + PRIOR * F.col(f"p_{s}")) / (F.col(f"n_{s}") + PRIOR)).alias(f"p_{s}")
                    for s in sides
                ),
            )
        lower = known
    return lower.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, log_odds`` of every url.

    ``rule`` is the longest rule that fits, as host and path, else NULL. ``verdict`` is what
    the rule says, else ``allow`` for calibrated odds of 1 or more of being accepted, else
    ``block``. A NULL url, or one without ``://``, has an empty host and path; a NULL url is
    modelled as the empty one. Urls of a fifth of the rule-judged ones (by their MD5) calibrate and do
    not teach. Without accepted or without rejected ones the odds stay uncalibrated log
    ratios. Repeated rows are judged alike and stay, and repeated urls teach as often as
    they occur. An empty table gives no rows; other columns are ignored.
    """
    given = F.col(f"`{url}`").cast("string")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.coalesce(given, F.lit("")).alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    host, path = F.col("host"), F.col("path")
    rows = rows.withColumn("rule", _first_rule(host, path, rules, lambda rule: rule.name))
    rows = rows.withColumn("said", _first_rule(host, path, rules, lambda rule: rule.action))

    held_back = F.substring(F.md5(F.col("url").cast("binary")), 1, 1) < "3"
    key = [F.xxhash64("url").alias("k1"), F.xxhash64("url", F.lit(1)).alias("k2")]
    urls = rows.groupBy("url", "said").agg(F.count("*").alias("n"))
    tells = (F.col("said").isNotNull() & held_back).alias("tells")
    urls = stored(urls.select(*key, "url", "said", "n", tells), "urls")
    # Urls are few bytes beside their grams: tasks are dealt by rows, not by size.
    tasks = max(math.ceil(urls.count() / URLS_PER_TASK), 1)
    urls = urls.repartition(tasks, "k1", "k2")
    teaches = F.col("said").isNotNull() & ~F.col("tells")
    exploded = urls.select(
        F.explode(_grams(F.col("url"))).alias("gram"),
        *(
            F.when(teaches & (F.col("said") == said), F.col("n")).otherwise(0).alias(side)
            for said, side in (("allow", "accepted"), ("block", "rejected"))
        ),
    )
    sides = (F.sum(side).alias(side) for side in ("accepted", "rejected"))
    grams = stored(exploded.groupBy("gram").agg(*sides, F.count("*").alias("seen")), "grams")
    ratios = stored(_model(grams).join(grams.select("gram", "seen"), "gram"), "ratios")

    # Every url holds the grams of its start: the frequent ones are sent to all tasks, the others joined.
    least = (ratios.agg(F.sum("seen")).first()[0] or 0) / FREQUENT
    often = F.broadcast(ratios.filter(F.col("seen") >= least).select("gram", "ratio"))
    seldom = ratios.filter(F.col("seen") < least).select("gram", "ratio")
    judged = urls.filter(F.col("said").isNull() | F.col("tells"))
    judged = judged.select("k1", "k2", F.explode(_grams(F.col("url"))).alias("gram")).join(often, "gram", "left")
    rest = judged.filter("ratio is null").drop("ratio").join(seldom, "gram")
    found = judged.filter("ratio is not null").unionByName(rest)
    sums = found.groupBy("k1", "k2").agg(F.avg("ratio").alias("ratio"))
    scores = stored(
        urls.select("k1", "k2", "said", "n").join(sums, ["k1", "k2"]).select("k1", "k2", "said", "n", "ratio"), "scores"
    )
    n, x = F.col("n"), F.col("ratio")
    by_side = {
        row["said"]: row
        for row in scores.filter("said is not null")
        .groupBy("said")
        .agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * x * x).alias("xx"))
        .collect()  # two rows
    }
    middle, slope = 0.0, 1.0
    if len(by_side) == 2:
        yes, no = by_side["allow"], by_side["block"]
        a, b = yes["x"] / yes["n"], no["x"] / no["n"]
        spread = (yes["xx"] + no["xx"] - yes["n"] * a * a - no["n"] * b * b) / (yes["n"] + no["n"])
        if a > b and spread > 1e-12:
            middle, slope = (a + b) / 2, (a - b) / spread
    odds = F.round((F.col("ratio") - middle) * slope, 6)
    unruled = scores.filter("said is null").select("k1", "k2", odds.alias("log_odds"))
    joined = rows.withColumns({"k1": key[0], "k2": key[1]}).join(unruled, ["k1", "k2"], "left")
    verdict = F.coalesce("said", F.when(F.col("log_odds") >= 0, "allow").otherwise("block"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "log_odds")
