"""URL filter: block and allow rules, and a character language-model ratio for the rest. DataFrame functions only.

The URLs that a rule decides are the training data: one variable-order Markov model of characters for the accepted
and one for the rejected. A model is the exact number of times each run of one to five characters, and each context of up to four,
stands in its URLs; the probability of a character interpolates the orders, p_o = (n(context, c) + w p_(o-1)) /
(n(context) + w), so the probabilities after a context add up to 1. A URL that no rule decides is allowed if its
log-likelihood difference, divided by its length, reaches the cut with the least mean error on a held-out part of the
rule-decided URLs.

The counts are a table with a row for each distinct run of the longest order, which grows with the input; shorter runs
and contexts are sums of it. It never reaches the driver: positions meet their run's log ratio by a join. Up to ``BROADCAST_RUNS`` runs
(16 bytes each), the most frequent ones, are broadcast, so none that is left has more than a small part of all positions; the
others are joined by a shuffle. Ratios are whole multiples of 1e-9, so that a URL's sum does not depend on the order of its terms.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; a URL without
characters scores 0; rows that repeat an id are judged each for itself; ids may be null (folded as empty); without
held-out URLs of both classes the cut is 0. Characters outside ``ALPHABET`` count as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from annoscope.session import written as saved

#: (rule, verdict); a rule is a host, then a path from its first slash on.
RULES: tuple[tuple[str, str], ...] = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_:?=&#%"  # then one symbol before the text, one for any other character
SYMBOLS, ORDERS, WEIGHT = len(ALPHABET) + 2, 5, 2.0
BEFORE, OTHER = SYMBOLS - 2, SYMBOLS - 1
UNIT = 1e-9  # of log ratios
BROADCAST_RUNS = 1_000_000
CUTS, RANGE = 600, 3.0  # the cut's grid: steps from -RANGE to RANGE
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits: of the host or a domain above it, with the path's beginning."""
    out = F.lit(None).cast("string")
    for name, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, rest = name.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(slash + rest)
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def runs(url: Column) -> Column:
    """For each character its run of ``ORDERS`` characters, as a number to the base ``SYMBOLS``: array<long>."""
    text = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    code = lambda c: F.pmod(F.call_function("instr", F.lit(ALPHABET), c) - 1, F.lit(SYMBOLS)).cast("long")  # noqa: E731  (none: OTHER)
    codes = F.when(F.length(text) > 0, F.transform(F.split(text, ""), code)).otherwise(F.array().cast("array<long>"))
    padded = F.concat(F.array(*[F.lit(BEFORE).cast("long")] * (ORDERS - 1)), codes)
    at = lambda p, i: sum(F.element_at(p, i - o) * F.lit(SYMBOLS**o) for o in range(ORDERS))
    every = lambda p: F.transform(F.sequence(F.lit(ORDERS), F.greatest(F.size(p), F.lit(ORDERS))), lambda i: at(p, i))
    return F.element_at(F.transform(F.array(padded), lambda p: F.when(F.size(p) >= ORDERS, every(p)).otherwise(F.array().cast("array<long>"))), 1)


def count_runs(positions: DataFrame) -> DataFrame:
    """(run, n, accepted, rejected): how often each run stands in all URLs, and in the training URLs of each class, from rows
    (run, trains), where ``trains`` is true for accepted, false for rejected, and null for other URLs."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return positions.groupBy("run").agg(F.count(F.lit(1)).alias("n"), one(F.col("trains")).alias("accepted"), one(~F.col("trains")).alias("rejected"))


def probabilities(counts: DataFrame, order: int = ORDERS) -> DataFrame:
    """(run, p_accepted, p_rejected): each run's last character after the others, for every run of ``order`` characters that
    ends a run of ``counts``."""
    names = ("accepted", "rejected")
    cut_to = lambda k: (F.col("run") % F.lit(SYMBOLS**k)).alias("run")
    context = lambda: ((F.col("run") - F.col("run") % SYMBOLS) / SYMBOLS).cast("long").alias("context")
    here = counts.select("run", *names) if order == ORDERS else counts.groupBy(cut_to(order)).agg(*[F.sum(c).alias(c) for c in names])
    total = here.groupBy(context()).agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    rows = here.withColumn("context", context()).join(total, "context")
    if order > 1:
        less = probabilities(counts, order - 1).withColumnRenamed("run", "shorter")
        rows = rows.withColumn("shorter", F.col("run") % F.lit(SYMBOLS ** (order - 1))).join(less, "shorter")
    else:
        rows = rows.select("*", *[F.lit(1.0 / SYMBOLS).alias(f"p_{c}") for c in names])
    return rows.select("run", *[((F.col(c) + F.lit(WEIGHT) * F.col(f"p_{c}")) / (F.col(f"all_{c}") + F.lit(WEIGHT))).alias(f"p_{c}") for c in names])


def ratios(counts: DataFrame) -> DataFrame:
    """(run, n, points): log ratio of the two models in units of ``UNIT``."""
    points = F.floor((F.log("p_accepted") - F.log("p_rejected")) / UNIT + 0.5)
    return probabilities(counts).select("run", points.alias("points")).join(counts.select("run", "n"), "run")


def score(rows: DataFrame, table: DataFrame, most: int = BROADCAST_RUNS) -> DataFrame:
    """(row, score) of rows (row, runs): the mean log ratio of each URL with characters. At most ``most`` runs are broadcast."""
    positions = rows.select("row", F.explode("runs").alias("run"))
    level = F.floor(F.log2(F.col("n"))).cast("int")
    sizes = {r["level"]: r["k"] for r in table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()}  # one row a power of two
    least, kept = max(sizes, default=0) + 1, 0
    while least > 0 and kept + sizes.get(least - 1, 0) <= most:
        least, kept = least - 1, kept + sizes.get(least - 1, 0)
    mean = lambda known: known.groupBy("row").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("n"))
    frequent = F.broadcast(table.where(level >= least).select("run", "points"))
    if least == 0:
        sums = mean(positions.join(frequent, "run"))
    else:
        rare = positions.join(frequent, "run", "left_anti").join(table.where(level < least).select("run", "points").hint("shuffle_hash"), "run")
        sums = mean(positions.join(frequent, "run")).unionByName(mean(rare)).groupBy("row").agg(F.sum("points").alias("points"), F.sum("n").alias("n"))
    return sums.select("row", (F.col("points") * UNIT / F.col("n")).alias("score"))


def held_out(page_id: Column) -> Column:
    """The part of the rule-decided URLs that sets the cut: 3 of 16."""
    return F.substring(F.md5(F.coalesce(page_id.cast("string"), F.lit(""))), 1, 1).isin("0", "1", "2")


def cut(scored: DataFrame) -> float:
    """The grid value with the least mean of the two error rates, from rows (score, accepted); the middle one of equals."""
    step = 2 * RANGE / CUTS
    cell = F.least(F.greatest(F.floor((F.col("score") + RANGE) / step), F.lit(0)), F.lit(CUTS - 1)).cast("int")
    rows = scored.groupBy(cell.alias("cell")).agg(F.sum(F.col("accepted").cast("int")).alias("good"), F.count(F.lit(1)).alias("n")).collect()
    good, bad = [0] * CUTS, [0] * CUTS
    for r in rows:
        good[r["cell"]], bad[r["cell"]] = r["good"], r["n"] - r["good"]
    goods, bads = sum(good), sum(bad)
    if not goods or not bads:
        return 0.0
    lost, passed, errors = 0, bads, []
    for i in range(CUTS):
        errors.append(lost / goods + passed / bads)
        lost, passed = lost + good[i], passed - bad[i]
    least = [i for i, e in enumerate(errors) if e == min(errors)]
    return -RANGE + least[len(least) // 2] * step


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; ``score`` is the model's, also where a rule decides."""
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r])
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.select("*", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules)).withColumn("told", verdicts[F.col("rule")])
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    training = F.when(~held_out(F.col("page_id")), F.col("told") == "allow").alias("trains")
    counts = saved(count_runs(rows.select(F.explode(runs(F.col("url"))).alias("run"), training)), "url-runs")
    points = saved(score(rows.select("row", runs(F.col("url")).alias("runs")), saved(ratios(counts), "url-ratios")), "url-scores")
    rows = rows.join(points, "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    level = cut(rows.where(F.col("rule").isNotNull() & held_out(F.col("page_id"))).select((F.col("told") == "allow").alias("accepted"), "score"))
    verdict = F.coalesce("told", F.when(F.col("score") >= level, "allow").otherwise("block"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
