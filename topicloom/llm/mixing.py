"""Mixing documents so that soft domains reach target weights.

A naive Bayes classifier over binned measures and informative words, counted on a table of labelled documents, gives
every document a posterior over the domains.  Rates per document, none negative, are then fitted so that the expected
tokens of each domain reach its target: projected gradient on the least squares of the misses, weighted
by the inverse of the tokens' second moments, which makes its steps long.  A pass is one aggregate over a narrow table,
and a rate is a fold over the residuals of the passes, so nothing is stored between them.  All DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.words import lines_of, words_of
from topicloom.runtime import materialise


@dataclass(frozen=True)
class MixParams:
    """``weights``: domain (``q<quality>t<toxic>`` of the labels) -> share of the expected tokens of those named.

    Domains that are not named keep their tokens.  ``total_tokens`` of those named: None stands for the smallest total at which
    none has to shrink.  The informative words are chosen on about ``sample_rows`` labelled documents; the
    classifier's counts take all of them.  The passes end when the targets are met to ``tolerance`` of all tokens, or
    when a pass moves the expected tokens by less than ``stall`` of them: rates of 0 or more cannot meet every target.
    """

    weights: dict[str, float] = field(default_factory=lambda: {"q1t0": 0.78, "q0t0": 0.12, "q1t1": 0.10})
    total_tokens: float | None = None
    sample_rows: int = 8000
    words: int = 24
    min_documents: int = 20
    smoothing: float = 1.0
    passes: int = 60
    tolerance: float = 1e-7
    stall: float = 1e-4


# measure -> its numerator, denominator, and the upper limits of its bins
BINS = {
    "symbols": ("n_symbols", "n_chars", (0.0, 0.02, 0.08)),
    "capitals": ("n_capitals", "n_chars", (0.0, 0.05, 0.1, 0.4)),
    "calls": ("n_calls", "n_chars", (0.0, 0.02)),
    "word_length": ("n_chars", "n_tokens", (3.5, 4.5, 5.5, 6.5, 7.5)),
    "variety": ("n_distinct", "n_tokens", (0.1, 0.25, 0.5, 0.75, 0.9)),
    "lines": ("n_own_lines", "n_lines", (0.5, 0.8, 0.95)),
}
SIZE_BINS = (1, 4, 16, 64, 256, 1024, 4096)
HIT_BINS = (0, 1, 2)


def labelled(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` of the rows with both labels."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


def informative_words(docs: DataFrame, domains: DataFrame, p: MixParams) -> dict[str, list[str]]:
    """For each domain the words whose documents lean most towards it; at most ``words`` of each reach the driver."""
    n = domains.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, p.sample_rows / max(1, n)))
    sample = docs.where(draw).join(domains.where(draw), "doc_id")
    seen = sample.select("domain", F.explode(F.array_distinct(words_of("text"))).alias("word")).groupBy("word", "domain").agg(F.count(F.lit(1)).alias("n"))
    of_domain = sample.groupBy("domain").agg(F.count(F.lit(1)).alias("docs"))
    every = sample.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    rows = seen.join(F.broadcast(of_domain), "domain")  # one row for each domain
    total = seen.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") >= p.min_documents)
    rows = rows.join(total, "word")
    odds = F.log((F.col("n") + 0.5) / (F.col("docs") + 1)) - F.log((F.col("all") - F.col("n") + 0.5) / (every - F.col("docs") + 1))
    strength = odds * F.sqrt("n")
    best = rows.withColumn("strength", strength).where((odds > math.log(2)) & (F.col("n") >= p.min_documents / 2))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("strength"), "word"))
    found: dict[str, list[str]] = {}
    for r in best.withColumn("place", place).where(F.col("place") <= p.words).select("domain", "word").orderBy("domain", "place").collect():
        found.setdefault(r["domain"], []).append(r["word"])
    return found


def bin_of(value: Column, limits) -> Column:
    """Number of the first limit that is not exceeded, else one more; null counts as 0."""
    out = F.lit(len(limits))
    for i in reversed(range(len(limits))):
        out = F.when(value <= limits[i], i).otherwise(out)
    return F.when(value.isNull(), 0).otherwise(out).cast("int")


def with_bins(docs: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """``(doc_id, n_tokens, bins)`` of every whole text; tokens are words between blanks."""
    count = lambda pattern: F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0))
    df = docs.select(
        "doc_id",
        words_of("text").alias("words"),
        lines_of("text").alias("lines"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_capitals"),
        count("!").alias("n_calls"),
    )
    hits = [F.size(F.array_intersect("words", F.array(*map(F.lit, words)))) for _, words in sorted(lexicon.items())]
    df = df.select(
        "doc_id",
        "n_symbols",
        "n_capitals",
        "n_calls",
        F.size("words").cast("long").alias("n_tokens"),
        F.length(F.array_join("words", "")).alias("n_chars"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("lines")).alias("n_own_lines"),
        *[h.alias(f"hits_{i}") for i, h in enumerate(hits)],
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    bins = [bin_of(ratio(a, b), limits) for a, b, limits in BINS.values()]
    bins += [bin_of(F.col("n_tokens"), SIZE_BINS)] + [bin_of(F.col(f"hits_{i}"), HIT_BINS) for i in range(len(hits))]
    return df.select("doc_id", "n_tokens", F.array(*bins).alias("bins"))


def fit_domains(binned: DataFrame, domains: DataFrame, p: MixParams) -> dict[str, tuple[float, list[list[float]]]]:
    """Domain -> log prior and, for each measure, the log chance of each bin; counted over all labelled documents."""
    known = binned.join(domains, "doc_id").select("domain", "bins")
    cells = known.select("domain", F.posexplode("bins").alias("measure", "bin")).groupBy("domain", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, dict[tuple[int, int], int]] = {}
    for r in cells.collect():  # domains x measures x bins
        counts.setdefault(r["domain"], {})[r["measure"], r["bin"]] = r["n"]
    if not counts:
        return {}
    limits = [x[2] for x in BINS.values()] + [SIZE_BINS]
    width = 1 + max(m for c in counts.values() for m, _ in c)
    sizes = [len(limits[m]) + 1 if m < len(limits) else len(HIT_BINS) + 1 for m in range(width)]
    every = sum(n for c in counts.values() for (m, _), n in c.items() if m == 0)
    model = {}
    for domain, c in sorted(counts.items()):
        own = sum(n for (m, _), n in c.items() if m == 0)
        table = [[math.log((c.get((m, b), 0) + p.smoothing) / (own + p.smoothing * sizes[m])) for b in range(sizes[m])] for m in range(width)]
        model[domain] = (math.log(own / every), table)
    return model


def with_posteriors(binned: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, n_tokens, p)``: chances of the domains in the order of the model."""
    logs = []
    for prior, table in model.values():
        of_bins = [F.get(F.array(*map(F.lit, row)), F.get("bins", F.lit(m))) for m, row in enumerate(table)]
        logs.append(reduce(lambda a, b: a + b, of_bins, F.lit(prior)))
    df = binned.select("doc_id", "n_tokens", F.array(*logs).alias("logs"))
    df = df.select("doc_id", "n_tokens", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return df.select("doc_id", "n_tokens", F.transform("e", lambda x: x / total).alias("p"))


def rate(steps: list[list[float]]) -> Column:
    """The rate after all steps: from 1 down each step's slope, never below 0."""
    if not steps:
        return F.lit(1.0)
    slope = lambda step: reduce(lambda a, b: a + b, [F.get("p", F.lit(d)) * F.get(step, F.lit(d)) for d in range(len(steps[0]))])
    numbers = ", ".join("array(" + ", ".join(f"{v!r}D" for v in step) + ")" for step in steps)
    return F.aggregate(F.expr(f"array({numbers})"), F.lit(1.0), lambda r, step: F.greatest(F.lit(0.0), r - slope(step)))


def fit_rates(soft: DataFrame, domains: list[str], p: MixParams) -> tuple[list[list[float]], dict[str, float], dict[str, float]]:
    """Steps of the projected gradient, the targets, and the expected tokens reached."""
    n, at = F.col("n_tokens").cast("double"), lambda d: F.get("p", F.lit(d))
    k = len(domains)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = soft.agg(*[F.sum(n * at(d)).alias(f"s{d}") for d in range(k)], *[F.sum(n * at(i) * at(j)).alias(f"m{i}_{j}") for i, j in pairs]).first()
    now = np.array([first[f"s{d}"] or 0.0 for d in range(k)])
    share = np.array([p.weights.get(d, 0.0) for d in domains])
    if share.sum() <= 0 or now.sum() <= 0:
        return [], dict(zip(domains, now)), dict(zip(domains, now))
    share = share / share.sum()
    total = p.total_tokens or (now[share > 0] / share[share > 0]).max()
    target = np.where([d in p.weights for d in domains], total * share, now)
    moments = np.zeros((k, k))
    for i, j in pairs:
        moments[i, j] = moments[j, i] = (first[f"m{i}_{j}"] or 0.0) / now.sum()
    inverse = np.linalg.pinv(moments, rcond=1e-9, hermitian=True)
    steps, scale = [], now.sum()
    for _ in range(p.passes):
        if np.abs(now - target).max() <= p.tolerance * scale:
            break
        steps.append((inverse @ ((now - target) / scale)).tolist())
        found = soft.agg(*[F.sum(n * at(d) * rate(steps)).alias(f"s{d}") for d in range(k)]).first()
        after = np.array([found[f"s{d}"] for d in range(k)])
        if np.abs(after - now).max() <= p.stall * scale:
            now = after
            break
        now = after
    return steps, dict(zip(domains, target)), dict(zip(domains, now))


def mixing_rates(docs: DataFrame, labels: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """``(doc_id, n_tokens, p, domain, rate, copies)`` for each row of ``docs``; ``domain`` has the largest posterior.

    ``copies`` is the rate rounded up or down by a hash of the id, so that its expectation is the rate.  Null and
    empty texts have 0 tokens and the posterior of their bins.  Without any usable label there are no domains: null
    ``p`` and ``domain``, rate 1.  Repeated rows are rows of their own; repeated labels count as often as they occur.
    """
    docs = docs.select("doc_id", "text")
    domains = materialise(labelled(labels), "domains")
    binned = materialise(with_bins(docs, informative_words(docs, domains, p)), "bins")
    model = fit_domains(binned, domains, p)
    if not model:
        none = binned.select("doc_id", "n_tokens", F.lit(None).cast("array<double>").alias("p"), F.lit(None).cast("string").alias("domain"))
        return none.select("*", F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    names = list(model)
    soft = materialise(with_posteriors(binned, model), "posteriors")
    steps, _, _ = fit_rates(soft, names, p)
    domain = F.get(F.array(*map(F.lit, names)), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    luck = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) / 1e6
    rows = soft.select("doc_id", "n_tokens", "p", domain.alias("domain"), rate(steps).alias("rate"))
    return rows.select("*", F.floor(F.col("rate") + luck).cast("int").alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """``docs`` with every row as often as its ``copies`` say; all columns stay.  Null ids stay once."""
    changed = mixing_rates(docs, labels, p).where("copies <> 1 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    rows = docs.join(changed.hint("merge"), F.col("doc_id") == F.col("__id"), "left")
    return rows.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.coalesce("__copies", F.lit(1)))).alias("__n")).drop("__n")
