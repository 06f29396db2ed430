"""URL filter: rules first, then a ratio of two character models.

A rule allows or blocks a host with its subdomains below a path; the
longest fitting rule decides. URLs with a rule are the examples of two
smoothed variable-order Markov models, one of accepted and one of rejected
URLs: the probability of a character after its context of up to ``ORDER``
characters is its share there, smoothed towards the probability after the
next shorter context. Every other URL is judged by the difference of its
log-likelihoods per character, against a threshold calibrated on examples
that the models have not seen.

Models see URLs without scheme, in lower case and with all digits alike;
equal ones are counted and scored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_ascii, small_side
from ledgerlens.operators.materialize import materialize, release

ORDER = 4
# weight of the shorter context, in observations
SMOOTHING = 2.0
FOLDS = 5  # one fold calibrates
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]
_START, _END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or without
    ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = F.coalesce(at > 0, F.lit(False))
    host = F.when(known, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")
    path = F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. Of equally long
    ones the first listed wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, below = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + below)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def model_text(url: Column) -> Column:
    """What the models read; empty for a null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", "")
    return F.translate(lower_ascii(rest), "0123456789", "0000000000")


def _windows(texts: DataFrame, order: int) -> DataFrame:
    """Each text's characters and its end, with the characters before."""
    padded = F.concat(F.lit(_START * order), F.col("form"), F.lit(_END))
    at = F.explode(F.sequence(F.lit(1), F.length("form") + 1))
    return texts.withColumn("padded", padded).withColumn("at", at).withColumn(
        "window", F.substring("padded", F.col("at"), F.lit(order + 1))).drop("padded", "at")


def _suffixes(windows: DataFrame, order: int) -> DataFrame:
    """The n-grams at the end of each window, of length 1 to ORDER + 1."""
    n = F.explode(F.sequence(F.lit(1), F.lit(order + 1)))
    return windows.withColumn("n", n).withColumn(
        "gram", F.substring("window", F.lit(order + 2) - F.col("n"), F.col("n"))).withColumn(
        "context", F.substring("gram", F.lit(1), F.col("n") - 1))


def train(examples: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Counts ``gram, ca, cr`` and ``context, n, ta, tr`` from ``form,
    accepted, weight``."""
    counted = _windows(examples, order).groupBy("window").agg(
        F.sum(F.when(F.col("accepted"), F.col("weight")).otherwise(0)).alias("ca"),
        F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("weight"))).alias("cr"))
    counted = _suffixes(counted, order)
    grams = counted.groupBy("gram").agg(F.sum("ca").alias("ca"), F.sum("cr").alias("cr"))
    contexts = counted.groupBy("context", "n").agg(F.sum("ca").alias("ta"), F.sum("cr").alias("tr"))
    return materialize(grams, "url-grams"), materialize(contexts, "url-contexts")


def score(texts: DataFrame, model: tuple[DataFrame, DataFrame], order: int = ORDER,
          smoothing: float = SMOOTHING) -> DataFrame:
    """``form, score``: mean log-likelihood difference per character."""
    grams, contexts = model
    places = _windows(texts.select("form"), order)
    suffixes = _suffixes(places.select("window").distinct(), order)
    known = suffixes.join(small_side(grams), "gram", "left").join(
        small_side(contexts), ["context", "n"], "left")
    steps = known.groupBy("window").agg(F.sort_array(F.collect_list(F.struct(
        "n", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("ca", "cr", "ta", "tr")]
    ))).alias("steps"))  # ORDER + 1 entries
    unseen = 1.0 / 256

    def deeper(acc: Column, s: Column) -> Column:
        return F.struct(((s["ca"] + smoothing * acc["a"]) / (s["ta"] + smoothing)).alias("a"),
                        ((s["cr"] + smoothing * acc["r"]) / (s["tr"] + smoothing)).alias("r"))

    ratio = F.aggregate("steps", F.struct(F.lit(unseen).alias("a"), F.lit(unseen).alias("r")), deeper,
                        lambda acc: F.log(acc["a"]) - F.log(acc["r"]))
    ratios = materialize(steps.select("window", ratio.alias("ratio")), "url-windows")
    return places.join(small_side(ratios), "window").groupBy("form").agg(
        F.avg("ratio").alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best mean of both classes' shares judged
    right, on ``score, accepted, weight``; scores are binned to 0.01 (a few
    thousand bins). 0 without examples of both classes."""
    bins = scored.groupBy(F.round("score", 2).alias("score")).agg(
        F.sum(F.when(F.col("accepted"), F.col("weight")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("weight"))).alias("r"))
    every = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    quality = (1 - F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(every)
               + F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(every))
    totals = bins.agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    if not totals["a"] or not totals["r"]:
        return 0.0
    best = bins.withColumn("quality", F.round(quality, 6)).agg(
        F.max_by("score", F.struct("quality", -F.abs("score"))).alias("t")).first()["t"]
    return float(best) - 0.005  # the lower edge of the bin


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, order: int = ORDER,
               smoothing: float = SMOOTHING, id_col: str = "page_id", url_col: str = "url"
               ) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict`` (allow
    or block) and ``score`` (null where a rule decides).

    A null, empty or blank URL fits no rule, has score null and is blocked.
    Without examples every score is 0 and allowed. Equal URLs get equal
    verdicts. An empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url_col))
    rule, decision = fitting_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"),
                          model_text(F.col(url_col)).alias("form")).withColumns(
        {"rule": rule, "decision": decision})
    forms = materialize(parsed.groupBy("form", "decision").agg(
        F.count(F.lit(1)).alias("weight")), "url-forms")
    examples = forms.filter("decision is not null").select(
        "form", (F.col("decision") == "allow").alias("accepted"), "weight",
        (F.pmod(F.xxhash64("form"), F.lit(FOLDS)) == 0).alias("check"))
    model = train(examples.filter("not check"), order)
    checks = examples.filter("check")
    unjudged = forms.filter("decision is null and trim(form) <> ''").select("form")
    scores = materialize(score(unjudged.union(checks.select("form")).distinct(), model, order,
                               smoothing), "url-scores")
    threshold = calibrate(checks.join(scores, "form"))
    result = parsed.join(small_side(scores), "form", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("decision", F.when(F.col("score") >= threshold, F.lit("allow"))
                   .otherwise(F.lit("block"))).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
    release(*model, forms)
    return result
