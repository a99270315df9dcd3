import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from skein.llm.url_filter import END, HELD, ORDER, RULES, START, Rule, host_of, longest_rule, path_of, url_verdicts


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: s[: min([s.index(m) for m in marks if m in s], default=len(s))]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)


def brute(urls, rules=RULES, order=ORDER, most=16_384):
    """Verdicts with models that look chances up context by context."""
    texts = {}
    for u in urls:
        host, path = parts(u)
        rule = rule_of(host, path, rules)
        texts[host + path] = rule and rule.verdict
    held = {t for t in texts if hashlib.md5(t.encode()).hexdigest()[0] in HELD}
    counts = {c: [Counter() for _ in range(order + 1)] for c in ("allow", "block")}
    for t, label in texts.items():
        if label and t not in held:
            marked = START + t + END
            for k in range(1, len(marked)):
                for n in range(min(order, k) + 1):
                    counts[label][n][marked[k - n : k + 1]] += 1
    symbols = len(set(counts["allow"][0]) | set(counts["block"][0])) + 1
    least = {c: max(1, -(-sum(counts[c][0].values()) // most)) for c in counts}

    known = {c: [{} for _ in range(order + 1)] for c in counts}
    for c in counts:
        for n in range(order + 1):
            for gram, count in counts[c][n].items():
                known[c][n].setdefault(gram[:-1], {})[gram[-1]] = count

    def chance(c, context, x):
        p = 1 / symbols
        for n in range(len(context) + 1):
            of = known[c][n].get(context[len(context) - n :], {})
            whole = sum(of.values())
            if whole >= least[c]:
                kept = {y: m for y, m in of.items() if m >= least[c]}
                p = (kept.get(x, 0) + (whole + len(of) - sum(kept.values())) * p) / (whole + len(of))
        return p

    scores = {}
    for t in texts:
        marked = START + t + END
        steps = [(marked[max(0, k - order) : k], marked[k]) for k in range(1, len(marked))]
        scores[t] = sum(math.log(chance("allow", *s)) - math.log(chance("block", *s)) for s in steps) / len(steps) * 1000
    return texts, held, scores


def sample(n=500, seed=4):
    rng = random.Random(seed)
    words = lambda good: "-".join(rng.choice(["river", "stone", "green", "hill"] if good else ["pills", "casino", "cheap", "xxx"]) for _ in range(2))
    urls = []
    for k in range(n):
        good, top = rng.random() < 0.5, rng.choice(["com", "net", "net"])
        lang = "fr" if good else "de"
        urls.append(f"https://{words(good)}.example.{top}/{lang}/{words(good)}{k % 9}" + rng.choice(["", "?a=/b", "#x"]))
    return urls


def test_parts_and_rules(spark):
    urls = [None, "", "no-scheme.org/x", "http://A.Example.ORG/es/1?x#y", "x://org/", "x://org", "x://notorg/", "a://b.com/fr/", "a://b.com/de", "a://b.com/de/ÄB://c", "a://?q", "a://b#c/d", "://h.org//", "http://example.org/en/19", "q://É.com/fr/x\ny"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    rows = rows.withColumn("r", longest_rule(F.col("h"), F.col("p"), RULES, "name")).withColumn("v", longest_rule(F.col("h"), F.col("p"), RULES, "verdict"))
    for r in rows.collect():
        rule = rule_of(*parts(r.u), RULES)
        assert (r.h, r.p) == parts(r.u) and r.r == (rule and rule.host + rule.path) and r.v == (rule and rule.verdict)


def test_equally_long_rules_go_by_host(spark):
    rules = [Rule("allow", "com", "/ab"), Rule("block", "x.com", "/")]
    row = spark.range(1).select(longest_rule(F.lit("x.com"), F.lit("/ab"), rules, "name").alias("r")).first()
    assert row.r == "x.com/"


def check(spark, urls, most):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_verdicts(df, most=most).collect()}
    texts, held, scores = brute(urls, most=most)
    threshold = got[0].threshold
    for k, u in enumerate(urls):
        text = "".join(parts(u))
        assert abs(got[k].score - math.floor(scores[text])) <= 1 and got[k].threshold == threshold
        assert got[k].verdict == (texts[text] or ("allow" if got[k].score >= threshold else "block"))
    return texts, held, scores, got


def test_verdicts_by_brute_force(spark):
    urls = [*sample(), None, "nothing", "https://river.example.net/xx", "https://river.example.net/xx"]
    texts, held, scores, got = check(spark, urls, 16_384)
    wrong = sum((scores[t] >= got[0].threshold) != (texts[t] == "allow") for t in held if texts[t])
    assert wrong == 0 and sum(1 for t in held if texts[t]) > 20
    plain = [(u, got[k].verdict) for k, u in enumerate(urls[:500]) if got[k].rule is None]
    assert len(plain) > 200 and all((v == "allow") == ("/fr/" in u) for u, v in plain)


def test_rare_contexts_fall_back(spark):
    check(spark, sample(200, 9), 40)


def test_one_class_nulls_repeats_and_clashes(spark):
    rows = [(None, "https://a.org/x"), (None, "https://a.org/x"), (1, "https://b.net/"), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS text", "3 AS label", "4 AS score")
    got = sorted(map(tuple, url_verdicts(df).select("page_id", "host", "path", "rule", "verdict", "threshold").collect()), key=str)
    assert len(got) == 5 and {r[5] for r in got} == {0} and got.count((None, "a.org", "/x", "org/", "allow", 0)) == 2
    none = spark.createDataFrame([(1, "https://b.net/"), (2, None)], "page_id long, url string")
    assert {(r.verdict, r.score) for r in url_verdicts(none).collect()} == {("allow", 0)}


def test_verdicts_on_nothing(spark):
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string")).collect() == []
