"""Soft-membership mixing of sources to target weights (op7).

DataFrame functions only.  A classifier fitted on a bounded sample of the labelled table gives
every document's domain posteriors; nonnegative rates r minimise

    sum over domains k of (sum_i tokens_i * p_ik * r_i - target_k)^2 / scale_k,

with scale_k the larger of what the domain has, its target and a least share, by accelerated projected gradient steps from r = 1.  A step moves a document's rate by its
posteriors times one vector of domain residuals, so a rate is a fold over the residual vectors
of all steps: each step is one aggregate over a skinny table, and only one number per domain
comes to the driver.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams, store

#: Buckets of the classifier, most labelled rows it is fitted on (smallest hashes), smoothing,
#: the shrinkage of its weights, the texts that a bucket's prior counts for, steps, tokens
#: wanted over tokens there, and the relative residual at which the steps end.
BUCKETS, LABELLED, SMOOTHING, SHRINK, PRIOR, STEPS, EPOCHS, CLOSE = 65_536, 20_000, 0.5, 0.5, 14.0, 200, 1.2, 1e-3
#: A domain's residual counts as at least this share of all tokens; steps after which states are
#: written; labelled texts that must have a bucket for it to count.
LEAST_SHARE, WRITE_EVERY, LEAST_SEEN = 0.01, 6, 5
#: Steps without a hundredth's gain after which the fit ends.
STALLED = 10
#: A goal counts as missed by more than this share of all tokens wanted.
MISSED = 0.01
logger = logging.getLogger(__name__)
#: Domains of the labelled table and their target shares of tokens.
DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.97, "low": 0.01, "toxic": 0.02}


def domain(quality: Column, toxic: Column) -> Column:
    """A labelled row's domain; null if a label is missing."""
    return F.when(toxic == 1, "toxic").when((toxic == 0) & (quality == 1), "good").when((toxic == 0) & (quality == 0), "low")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, most: int = LABELLED, smoothing: float = SMOOTHING) -> tuple[DataFrame, dict]:
    """One row with an array of log-ratios by bucket for each domain, and the domains' log priors."""
    named = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    sample = named.select(F.col("doc_id").alias("label_id"), domain(F.col("q"), F.col("t")).alias("domain")).where("domain is not null").orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "label_id")
    one = F.array_distinct(grams.buckets_of(grams.words(F.col("text")), buckets))
    counts = grams.exploded(rows, one, "bucket", "domain").groupBy("bucket").agg(*[F.count_if(F.col("domain") == d).alias(f"n_{d}") for d in DOMAINS])
    counts = store.written(counts, "counts")
    totals = counts.agg(*[F.coalesce(F.sum(f"n_{d}"), F.lit(0)).alias(d) for d in DOMAINS]).first().asDict()
    size = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}  # one row for each domain
    everything = sum(totals.values())
    n = sum(size.values())
    row = sum((F.col(f"n_{d}") for d in DOMAINS), F.lit(0))

    def ratio(d):
        # the domain's share of a bucket leans on its share of everything, so rare words carry little
        share = F.lit((totals[d] + smoothing) / (everything + smoothing * len(DOMAINS)))
        x = F.log((F.col(f"n_{d}") + share * PRIOR) / ((row + PRIOR) * share))
        return F.when(row >= LEAST_SEEN, F.signum(x) * F.greatest(F.abs(x) - F.lit(SHRINK), F.lit(0.0))).otherwise(F.lit(0.0))

    weights = counts.select("bucket", *[ratio(d).alias(d) for d in DOMAINS])
    prior = {d: math.log((size.get(d, 0) + 1) / (n + len(DOMAINS))) for d in DOMAINS}
    return grams.as_row(weights, "bucket", list(DOMAINS), buckets, {d: F.lit(0.0) for d in DOMAINS}), prior


def with_posteriors(docs: DataFrame, row: DataFrame, prior: dict, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """docs (as a struct column _doc) with ``m``: tokens (words) and posteriors p, in the order of DOMAINS."""
    inner = grams.with_row(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")), row)

    def member(places):
        def posterior(b):
            logs = F.array(*[grams.total(b, F.col(d)) + F.lit(prior[d]) for d in DOMAINS])

            def normal(x):
                return grams.let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))

            return F.struct(F.size(places).cast("long").alias("tokens"), grams.let(logs, normal).alias("p"))

        return grams.let(F.array_distinct(places), posterior)

    return grams.once(inner, "_doc", grams.let(grams.buckets_of(grams.words(F.col("_doc")[text_col]), buckets), member).alias("m"))


def state(p: Column, history: list[list[float]], momentum: list[float], start: Column | None = None) -> Column:
    """A document's rate r after the recorded steps and the point y where the next gradient is taken."""
    if not history:
        return F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")) if start is None else start
    steps = F.from_json(F.lit(str([g + [b] for g, b in zip(history, momentum, strict=True)])), "array<array<double>>")

    def step(a, g):
        move = sum((p[k] * g[k] for k in range(len(history[0]))), F.lit(0.0))
        new = F.greatest(F.lit(0.0), a["y"] - move)
        return F.struct(new.alias("r"), (new + g[len(history[0])] * (new - a["r"])).alias("y"))

    zero = start if start is not None else F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    return F.aggregate(steps, zero, step)


def fit_rates(members: DataFrame, targets: dict, steps: int = STEPS, epochs: float = EPOCHS) -> tuple[list, list, dict]:
    """Residual vectors and momenta of all steps over a written table (tokens, p), and the fit's totals.

    Every few steps the documents' states are written, so a step folds over few vectors.
    """
    names = list(DOMAINS)

    def sums(table: DataFrame, r: Column) -> list[float]:
        made = table.select("tokens", "p", r.alias("r"))
        row = made.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("p")[k] * F.col("r")), F.lit(0.0)) for k in range(len(names))]).first()
        return [float(x) for x in row]

    now = sums(members, F.lit(1.0))
    wanted = [targets[d] for d in names]
    goal = [epochs * sum(now) * w / (sum(wanted) or 1.0) for w in wanted]
    scale = [max(a, b, LEAST_SHARE * sum(now), 1.0) for a, b in zip(now, goal, strict=True)]
    history, momentum, at, t, losses = [], [], now, 1.0, []
    table, start, done = members, None, 0
    for _ in range(steps):
        g = [(a - b) / n for a, b, n in zip(at, goal, scale, strict=True)]
        losses.append(sum(x * x * n for x, n in zip(g, scale, strict=True)))
        # near the goals, or as near as documents of these domains come
        if max(abs(x) for x in g) < CLOSE or (len(losses) > STALLED and losses[-1] > 0.99 * losses[-1 - STALLED]):
            break
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        history.append(g)
        momentum.append((t - 1) / following)
        t = following
        if len(history) - done == WRITE_EVERY:
            before, table = table, store.written(table.select("tokens", "p", state(F.col("p"), history[done:], momentum[done:], start).alias("s")), "states")
            store.drop(before)
            start, done = F.col("s"), len(history)
        at = sums(table, state(F.col("p"), history[done:], momentum[done:], start)["y"])
    after = sums(table, state(F.col("p"), history[done:], momentum[done:], start)["r"])
    store.drop(table)
    return history, momentum, {"before": dict(zip(names, now, strict=True)), "goal": dict(zip(names, goal, strict=True)), "after": dict(zip(names, after, strict=True))}


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict | None = None, steps: int = STEPS, epochs: float = EPOCHS) -> DataFrame:
    """docs (struct column _doc) with tokens, p, rate, copies and residual.

    The targets are shares of ``epochs`` times the tokens there are.  copies is the rate rounded up or down by the hash of the id, so that its expectation is the
    rate.  residual is one number for all: how far the domains' tokens are from their goals,
    as the root of the sum of squares over all tokens wanted; goal and reached tokens of each domain
    are logged, a missed goal as a warning.  A null or empty text has no tokens and the priors as posteriors.  Without labelled
    rows all posteriors are equal to the priors.  Rows with a null id are rounded by the hash
    of null; repeated rows get equal copies.  An empty table gives an empty result.
    """
    row, prior = fit(docs, labels, id_col, text_col)
    row = store.written(row, "classifier")
    # texts are classified once; the steps read only the two narrow columns of what is written
    judged = store.written(with_posteriors(docs, row, prior, text_col).select("_doc", "m.tokens", "m.p"), "members")
    history, momentum, totals = fit_rates(judged.select("tokens", "p"), targets or TARGETS, steps, epochs)
    everything = sum(totals["goal"].values())
    residual = math.sqrt(sum((totals["after"][d] - totals["goal"][d]) ** 2 for d in DOMAINS)) / (everything or 1.0)
    for d in DOMAINS:
        goal, after = totals["goal"][d], totals["after"][d]
        missed = abs(after - goal) > MISSED * everything
        logger.log(logging.WARNING if missed else logging.INFO, "mixing %s: goal %.0f tokens, reached %.0f after %d steps%s", d, goal, after, len(history), ", missed" * missed)
    r = state(F.col("p"), history, momentum)["r"]
    u = F.pmod(F.xxhash64(F.col("_doc")[id_col], F.lit(77)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return judged.withColumn("rate", r).select("_doc", "tokens", "p", "rate", F.floor(F.col("rate") + u).cast("int").alias("copies"), F.lit(residual).alias("residual"))
