"""Verdicts on URLs: rules on hosts and paths, and two character models for what no rule fits.

URLs that rules allow and URLs that rules block each train a Markov model over characters
of variable order: a context of up to ``ORDER`` characters is used where it was seen often
enough, and each order's estimate is smoothed by the next lower one (Witten and Bell). A
URL's score is the difference of its log-likelihoods by its length. Where scores start to
mean "allow" is calibrated on labelled URLs that trained neither model.

Everything is SQL functions. Each different URL counts once, however many rows have it.
Counts cover all labelled URLs; of each order, a model keeps the n-grams with at least the
``MOST_GRAMS``-th part of all characters, so there are at most ``MOST_GRAMS`` of them
whatever the input (the rest of a context's weight goes to the lower order). That bounds the
tables that are broadcast. Log-ratios are whole millionths, so that sums don't depend on
the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import materialise
from skein.plans.hot import hot_join


class Rule(NamedTuple):
    """A verdict for a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
ORDER = 4
MOST_GRAMS = 16_384
#: URLs whose MD5 starts with one of these digits calibrate and don't train.
HELD = "012"
UNIT = 1_000_000
#: Scores are compared in thousandths a character.
STEP = 1_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
START, END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark or number sign; A to Z become small letters."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to a question mark or number sign."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule], give: str) -> Column:
    """``verdict``, or ``name``, of the longest rule that fits; of equally long ones that with the longer host. Null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.verdict if give == "verdict" else rule.host + rule.path)).otherwise(found)
    return found


def _marked(text: Column) -> Column:
    return F.concat(F.lit(START), text, F.lit(END))


def _gram(order: int) -> Column:
    """The character at place ``_k`` of ``_marked`` with ``order`` characters before it; null where there are fewer."""
    return F.when(F.col("_k") >= order, F.substring("_marked", F.col("_k") + 1 - order, F.lit(order + 1)))


def _places(texts: DataFrame) -> DataFrame:
    """A row for each character and for the end of each text."""
    marked = texts.withColumn("_marked", _marked(F.col("text")))
    return marked.withColumn("_k", F.explode(F.sequence(F.lit(1), F.length("_marked") - 1)))


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, allow, block``: in how many places of the texts with this ``label`` each n-gram of up to ``order + 1`` characters stands."""
    grams = _places(texts).select("label", F.explode(F.array(*[_gram(k) for k in range(order + 1)])).alias("gram")).where("gram IS NOT NULL")
    return grams.groupBy("gram").agg(*[F.count(F.when(F.col("label") == c, 1)).alias(c) for c in ("allow", "block")])


class Models(NamedTuple):
    """Log-ratios in units: ``grams`` by order (``gram, ratio``), ``contexts`` by order (``context, ratio``: of the weights left to the lower order), and of an unknown character."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    unknown: int


def _ratio(a: Column, b: Column) -> Column:
    return F.round((F.log(a) - F.log(b)) * UNIT).cast("long")


def train(counts: DataFrame, order: int = ORDER, most: int = MOST_GRAMS) -> Models:
    """The two models as tables of log-ratios, of at most ``2 * most`` rows each."""
    one = F.length("gram") == 1
    seen = counts.agg(*[F.coalesce(F.sum(F.when(one, F.col(c))), F.lit(0)).alias(c) for c in ("allow", "block")], F.count(F.when(one, 1)).alias("symbols")).first()
    least = {c: max(1, -(-seen[c] // most)) for c in ("allow", "block")}
    base = 1.0 / (seen["symbols"] + 1)
    split = counts.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)")).withColumn("lower", F.expr("substring(gram, 2)"))
    kept = {c: F.when(F.col(c) >= least[c], F.col(c)).otherwise(0) for c in least}
    weights = []
    for c in least:
        total, kinds, counted = F.sum(c), F.count(F.when(F.col(c) > 0, 1)), F.sum(kept[c])
        usable = total >= least[c]
        weights.append(F.when(usable, total + kinds).alias(f"{c}_whole"))
        weights.append(F.when(usable, (total + kinds - counted) / (total + kinds)).otherwise(1.0).alias(f"{c}_left"))
    contexts = split.groupBy("context").agg(*weights).where("allow_whole IS NOT NULL OR block_whole IS NOT NULL")
    contexts, _ = materialise(contexts, "url-contexts")
    grams, below, left = [], None, []
    for k in range(order + 1):
        rows = split.where((F.length("gram") == k + 1) & ((F.col("allow") >= least["allow"]) | (F.col("block") >= least["block"])))
        rows = rows.select("gram", "context", "lower", *[kept[c].alias(c) for c in least]).join(contexts, "context")
        rows = rows.join(below, "lower") if below is not None else rows.select("*", *[F.lit(base).alias(f"{c}_lower") for c in least])
        chances = [F.coalesce(F.col(c) / F.col(f"{c}_whole"), F.lit(0.0)) + F.col(f"{c}_left") * F.col(f"{c}_lower") for c in least]
        table, _ = materialise(rows.select("gram", *[p.alias(c) for p, c in zip(chances, least, strict=True)]), "url-model")
        below = table.select(F.col("gram").alias("lower"), *[F.col(c).alias(f"{c}_lower") for c in least])
        grams.append(table.select("gram", _ratio(F.col("allow"), F.col("block")).alias("ratio")))
        left.append(contexts.where(F.length("context") == k).select("context", _ratio(F.col("allow_left"), F.col("block_left")).alias("ratio")))
    first = left[0].first()
    return Models(grams, left, first["ratio"] if first else 0)


def score(texts: DataFrame, models: Models) -> DataFrame:
    """``texts`` (``text`` is unique) with ``score``, the log-ratio of each, and ``places``, its length with the end."""
    rows = _places(texts)
    total = F.lit(models.unknown).cast("long")
    for k, (grams, contexts) in enumerate(zip(models.grams, models.contexts, strict=True)):
        rows = rows.withColumn("_gram", _gram(k)).join(F.broadcast(grams.select(F.col("gram").alias("_gram"), F.col("ratio").alias(f"_g{k}"))), "_gram", "left").drop("_gram")
        if k:
            context = F.when(F.col("_k") >= k, F.substring("_marked", F.col("_k") + 1 - k, F.lit(k)))
            rows = rows.withColumn("_context", context).join(F.broadcast(contexts.select(F.col("context").alias("_context"), F.col("ratio").alias(f"_c{k}"))), "_context", "left").drop("_context")
            total = F.coalesce(F.col(f"_c{k}"), F.lit(0)) + total
        total = F.coalesce(F.col(f"_g{k}"), total)
    others = [F.first(c).alias(c) for c in texts.columns if c != "text"]
    return rows.withColumn("_total", total).groupBy("text").agg(*others, F.sum("_total").alias("score"), F.count(F.lit(1)).alias("places"))


def mean_score() -> Column:
    """The score by length, in thousandths a character, rounded down."""
    return F.expr(f"CAST(floor(score / (places * {STEP}D)) AS long)")


def calibrate(scored: DataFrame) -> int:
    """The mean score from which on URLs are allowed.

    Of the labelled rows, the shares of each class that fall on the wrong side are added;
    the least sum wins, of all values that give it the one next to 0, then the smaller. 0 if a class is missing.
    """
    # A mean score is a difference of logarithms of counts, so there are some 100,000 values at most.
    bins = scored.where("label IS NOT NULL").groupBy(mean_score().alias("at")).agg(*[F.count(F.when(F.col("label") == c, 1)).alias(c) for c in ("allow", "block")])
    below = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # All thresholds above the last score before and up to this one part the rows alike.
    nearest = F.greatest(F.lag("at").over(Window.orderBy("at")) + 1, F.least("at", F.lit(0).cast("long")))
    edges = bins.select(nearest.alias("edge"), *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in ("allow", "block")], *[F.sum(c).over(whole).alias(c) for c in ("allow", "block")])
    wrong = F.expr("allow_below * block + (block - block_below) * allow")
    best = edges.where("allow > 0 AND block > 0").orderBy(wrong, F.abs("edge"), "edge").first()
    return best["edge"] if best else 0


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, order: int = ORDER, most: int = MOST_GRAMS) -> DataFrame:
    """Every row's ``id, host, path, rule, verdict, score, threshold``.

    ``rule`` is the longest rule that fits (host and path), and ``verdict`` what it says; where
    none fits, ``rule`` is null and the URL is allowed if its mean log-ratio ``score`` (thousandths
    a character, of host and path) is at least ``threshold``.

    A null URL, and one without ``://``, has an empty host and path; it is scored as an empty
    text. Repeated rows get a row each, equal URLs equal verdicts; null ids are ids like others. An
    empty table gives an empty result; further columns are ignored. Where rules label no URL of
    a kind, that model knows nothing and the threshold is 0.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("_read"))
    host, path = F.col("host"), F.col("path")
    texts = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n"))
    label = longest_rule(host, path, rules, "verdict")
    # A host holds no slash and a path starts with one, so the text says what both were.
    texts = texts.select(F.concat("host", "path").alias("text"), "_n", label.alias("label"), F.substring(F.md5(F.concat("host", "path")), 1, 1).isin(*HELD).alias("held"))
    texts, _ = materialise(texts, "url-texts")
    counts, _ = materialise(gram_counts(texts.where("label IS NOT NULL AND NOT held"), order), "url-grams")
    scored, _ = materialise(score(texts, train(counts, order, most)), "url-scores")
    threshold = calibrate(scored.where("held"))
    total = scored.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    table = scored.select("text", "_n", "label", mean_score().alias("score"))
    found = hot_join(rows.withColumn("text", F.concat("host", "path")), table, ["text"], "_n", total, F.col("_read"))
    verdict = F.coalesce(F.col("label"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return found.select(F.col("_id").alias(id_col), "host", "path", longest_rule(host, path, rules, "name").alias("rule"), verdict.alias("verdict"), "score", F.lit(threshold).cast("long").alias("threshold"))


def verdict_sql(rules: Sequence[Rule] = RULES, order: int = ORDER, most: int = MOST_GRAMS) -> str:
    """The same verdicts on the table ``pages`` in SQL."""
    ranked = sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host)), reverse=True)
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ranked]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.host}{r.path}'" for f, r in zip(fits, ranked, strict=True)) + " END"
    label = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, ranked, strict=True)) + " END"
    grams = " UNION ALL ".join(f"SELECT label, substring(marked, k + 1 - {o}, {o + 1}) AS gram FROM places WHERE k >= {o} AND label IS NOT NULL AND NOT held" for o in range(order + 1))
    levels, joins, total = "", "", "(SELECT coalesce(max(ratio), 0) FROM left_over WHERE context = '')"
    for o in range(order + 1):
        lower = f"m{o - 1}.{{0}}" if o else "(SELECT 1.0 / (symbols + 1) FROM sizes)"
        chance = ", ".join(f"coalesce(CASE WHEN g.{c} >= s.{c}_least THEN g.{c} ELSE 0 END / c.{c}_whole, 0) + c.{c}_left * {lower.format(c)} AS {c}" for c in ("allow", "block"))
        below = f"JOIN m{o - 1} ON m{o - 1}.gram = substring(g.gram, 2)" if o else ""
        levels += f""", m{o} AS (
  SELECT g.gram, {chance}
  FROM sizes s, counts g JOIN contexts c ON c.context = substring(g.gram, 1, {o}) {below}
  WHERE length(g.gram) = {o + 1} AND (g.allow >= s.allow_least OR g.block >= s.block_least)
)"""
        joins += f" LEFT JOIN m{o} ON p.k >= {o} AND m{o}.gram = substring(p.marked, p.k + 1 - {o}, {o + 1})"
        if o:
            joins += f" LEFT JOIN left_over c{o} ON p.k >= {o} AND c{o}.context = substring(p.marked, p.k + 1 - {o}, {o})"
            total = f"coalesce(c{o}.ratio, 0) + {total}"
        total = f"coalesce(round((ln(m{o}.allow) - ln(m{o}.block)) * {UNIT})::BIGINT, {total})"
    held = ", ".join(f"'{c}'" for c in HELD)
    usable = ", ".join(
        f"CASE WHEN sum({c}) >= any_value({c}_least) THEN sum({c}) + count(*) FILTER (WHERE {c} > 0) END AS {c}_whole, "
        f"CASE WHEN sum({c}) >= any_value({c}_least) THEN (sum({c}) + count(*) FILTER (WHERE {c} > 0) - sum(CASE WHEN {c} >= {c}_least THEN {c} ELSE 0 END)) "
        f"/ (sum({c}) + count(*) FILTER (WHERE {c} > 0))::DOUBLE ELSE 1.0::DOUBLE END AS {c}_left"
        for c in ("allow", "block")
    )
    return f"""
WITH rows AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT *, host || path AS text, {rule} AS rule, {label} AS label FROM rows
), texts AS (
  SELECT DISTINCT text, label, substring(md5(text), 1, 1) IN ({held}) AS held FROM ruled
), places AS (
  SELECT text, label, held, marked, unnest(range(1, length(marked)::BIGINT)) AS k FROM (SELECT *, chr(2) || text || chr(3) AS marked FROM texts)
), counts AS (
  SELECT gram, count(*) FILTER (WHERE label = 'allow') AS allow, count(*) FILTER (WHERE label = 'block') AS block FROM ({grams}) GROUP BY gram
), sizes AS (
  SELECT greatest(1, ceil(coalesce(sum(allow), 0) / {most}.0)) AS allow_least, greatest(1, ceil(coalesce(sum(block), 0) / {most}.0)) AS block_least, count(*)::DOUBLE AS symbols
  FROM counts WHERE length(gram) = 1
), contexts AS (
  SELECT substring(gram, 1, length(gram) - 1) AS context, {usable} FROM counts, sizes GROUP BY 1
), left_over AS (
  SELECT context, round((ln(allow_left) - ln(block_left)) * {UNIT})::BIGINT AS ratio FROM contexts WHERE allow_whole IS NOT NULL OR block_whole IS NOT NULL
){levels}, scored AS (
  SELECT p.text, any_value(p.label) AS label, any_value(p.held) AS held, floor(sum({total}) / (count(*) * {STEP}.0::DOUBLE))::BIGINT AS score
  FROM places p{joins} GROUP BY p.text
), bins AS (
  SELECT score AS edge, count(*) FILTER (WHERE label = 'allow') AS allow, count(*) FILTER (WHERE label = 'block') AS block
  FROM scored WHERE held AND label IS NOT NULL GROUP BY score
), edges AS (
  SELECT greatest(lag(edge) OVER (ORDER BY edge) + 1, least(edge, 0)) AS edge, coalesce(sum(allow) OVER below, 0) AS allow_below, coalesce(sum(block) OVER below, 0) AS block_below, sum(allow) OVER () AS allow, sum(block) OVER () AS block
  FROM bins WINDOW below AS (ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), best AS (
  SELECT coalesce((SELECT edge FROM edges WHERE allow > 0 AND block > 0 ORDER BY allow_below * block + (block - block_below) * allow, abs(edge), edge LIMIT 1), 0) AS threshold
)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.label, CASE WHEN s.score >= b.threshold THEN 'allow' ELSE 'block' END) AS verdict,
       s.score, b.threshold
FROM ruled r JOIN scored s ON r.text = s.text, best b
"""
