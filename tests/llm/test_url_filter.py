import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from annoscope.llm import url_filter as uf


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    h, slash, p = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in h), slash + p


def rule_of(h, p):
    fits = [r for r, _ in uf.RULES if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith(r[r.index("/"):])]
    return max(fits, key=len) if fits else None


def brute(rows):
    """Rules and models recomputed in plain Python, with counts by dictionaries."""
    def cells(url):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
        known = ["^"] * (uf.ORDERS - 1) + [c if c in uf.ALPHABET else "other" for c in text]
        for i in range(uf.ORDERS - 1, len(known)):
            yield [(tuple(known[i - o:i + 1]), ("context", *known[i - o:i])) for o in range(uf.ORDERS)]

    said = dict(uf.RULES)
    judged = [(i, u, *parts(u), rule_of(*parts(u))) for i, u in rows]
    apart = lambda i: hashlib.md5(str("" if i is None else i).encode()).hexdigest()[0] in "012"
    tables = {"allow": Counter(), "block": Counter()}
    for i, u, _, _, r in judged:
        if r and not apart(i):
            tables[said[r]].update(x for e in cells(u) for pair in e for x in pair)

    def score(u):
        total, n = 0, 0
        for e in cells(u):
            n += 1
            ratio = 0.0
            for name, sign in (("allow", 1), ("block", -1)):
                p = 1 / uf.SYMBOLS
                for g, x in e:
                    p = (tables[name][g] + uf.WEIGHT * p) / (tables[name][x] + uf.WEIGHT)
                ratio += sign * math.log(p)
            total += math.floor(ratio / uf.UNIT + 0.5)
        return total * uf.UNIT / n if n else 0.0

    step = 2 * uf.RANGE / uf.CUTS
    held = [(min(max(math.floor((score(u) + uf.RANGE) / step), 0), uf.CUTS - 1), said[r]) for i, u, _, _, r in judged if r and apart(i)]
    good, bad = [c for c, v in held if v == "allow"], [c for c, v in held if v == "block"]
    level = 0.0
    if good and bad:
        errors = [sum(c < k for c in good) / len(good) + sum(c >= k for c in bad) / len(bad) for k in range(uf.CUTS)]
        least = [k for k, e in enumerate(errors) if e == min(errors)]
        level = -uf.RANGE + least[len(least) // 2] * step
    return [(i, h, p, r, said[r] if r else "allow" if score(u) >= level else "block") for i, u, h, p, r in judged]


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        name = "".join(rnd.choice(["th", "er", "spam", "blog"]) for _ in range(3))
        rows.append((i, f"http://{rnd.choice(['', 'www.', 'm.'])}{name}.example.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['en', 'fr', 'de'])}/{i}{rnd.choice(['', '?q=1', '#top'])}"))
    rows += [(900, None), (901, ""), (902, "no scheme.net/en/"), (903, "HTTP://Sub.EXAMPLE.net/en/x?y"), (904, "http://net"), (905, "http://net/"),
             (906, "http://notnet.internet/x"), (907, "x://a://b.org/fr/1"), (908, "http://Ünï.org/fr/é"), (909, "http://h.net\n/x"), (910, "http://example.com/de"),
             (None, "http://a.org/fr/"), (5, "http://again.net/"), (5, "http://again.net/"), (911, "http://host.org?q=/fr/"), (912, "://"), (913, "http://" + "l" * 20_000)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string").repartition(3)
    got = [tuple(r)[:5] for r in uf.judge(pages).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert {v for *_, r, v in got if r is None} == {"allow", "block"}


def test_empty_table_and_no_training_rows(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
    got = uf.judge(spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")).collect()
    assert [(r.rule, r.verdict, r.score) for r in got] == [(None, "allow", 0.0)]


def test_probabilities_after_a_context_add_up_to_one_at_most(spark):
    rnd = random.Random(2)
    some = ["".join(rnd.choice("abcdefgh/.") for _ in range(60)) for _ in range(4000)]  # about 200,000 positions, most runs distinct
    rows = spark.createDataFrame([(u, i % 3 == 0 if i % 5 else None) for i, u in enumerate(some)], "url string, trains boolean")
    counts = uf.count_runs(rows.select(F.explode(uf.runs(F.col("url"))).alias("run"), "trains")).cache()
    assert counts.count() > 80_000
    for order in range(1, uf.ORDERS + 1):
        p = uf.probabilities(counts, order)
        worst = p.groupBy(F.floor(F.col("run") / uf.SYMBOLS).alias("c")).agg(F.sum("p_accepted").alias("a"), F.sum("p_rejected").alias("b"))
        top = worst.agg(F.max("a"), F.max("b")).first()
        assert max(top) <= 1 + 1e-9
        assert p.where("p_accepted <= 0 or p_rejected <= 0").isEmpty()


def test_few_broadcast_runs_change_no_score(spark):
    rnd = random.Random(3)
    urls = ["http://" + "".join(rnd.choice("abcd./") for _ in range(30)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(urls)), "row long, url string").select("row", uf.runs(F.col("url")).alias("runs")).cache()
    counts = uf.count_runs(rows.select(F.explode("runs").alias("run"), F.when(F.col("row") % 3 < 2, F.col("row") % 3 == 0).alias("trains")))
    table = uf.ratios(counts).cache()
    whole = sorted(map(tuple, uf.score(rows, table).collect()))
    assert len(whole) == 400 and len({s for _, s in whole}) > 300
    for most in (0, 10, 700):
        assert sorted(map(tuple, uf.score(rows, table, most).collect())) == whole
