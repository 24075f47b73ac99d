"""Quality from weak labels.

Several heuristics vote good, bad or nothing on every document.  Expectation-maximisation estimates how
often each is right without any true label; it needs only the counts of the vote patterns, of which there are few.
The posterior of its pattern is then a document's soft label, and a linear scorer over hashed words and word
pairs learns from those.  Votes, patterns and scores cover all documents; the scorer is fitted on a
bounded sample.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import materialise

BLANKS = b" \t\n\v\f\r"
LABELLERS = ("length", "word_length", "symbols", "marks", "repeats", "lines", "capitals", "variety")


@dataclass(frozen=True)
class QualityParams:
    """``sample_rows`` bounds the documents that the scorer is fitted on; ``bits`` its hashed features."""

    sample_rows: int = 6000
    bits: int = 18
    em_steps: int = 100
    tolerance: float = 1e-7
    passes: int = 6
    rate: float = 0.5
    decay: float = 1e-6
    min_score: float = 0.5


def votes_of(text: str | None) -> list[int]:
    """1 good, 0 bad, -1 nothing, in the order of ``LABELLERS``; each looks at the whole text.

    A bad vote is meant to be rare and sure.  Short texts give few votes.
    """
    words = text.split() if text else []
    n = len(words)
    if n == 0:
        return [0] + [-1] * (len(LABELLERS) - 1)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, "#*$%&|<>"))
    marked = sum(w[-1] in "#*$%&!|" for w in words)
    upper = sum(map(str.isupper, words))
    distinct, triples = len(set(words)), len(set(zip(words, words[1:], words[2:])))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    different = len(set(lines))
    some, more = n >= 10, n >= 20

    def vote(good: bool, bad: bool) -> int:
        return 0 if bad else 1 if good else -1

    return [
        vote(n >= 50, False),
        vote(more and 3 <= chars / n <= 6.5, more and not 2 <= chars / n <= 7.5),
        vote(symbols * 100 <= chars, some and symbols * 20 > chars),
        vote(some and marked * 50 <= n, some and marked * 3 > n),
        vote(more and triples * 20 >= 19 * (n - 2), more and triples * 2 < n),
        vote(len(lines) > 2 and different * 10 >= 9 * len(lines), len(lines) > 4 and different * 2 < len(lines)),
        vote(some and upper * 20 < n, some and upper * 2 > n),
        vote(more and distinct * 2 > min(n, 400), more and distinct * 6 < min(n, 400)),
    ]


def vote_key(text: str | None) -> int:
    """The votes of a text as one number in base 3."""
    key = 0
    for v in votes_of(text):
        key = key * 3 + v + 1
    return key


def unpack(keys: np.ndarray) -> np.ndarray:
    """``(patterns, labellers)`` votes of packed patterns."""
    powers = 3 ** np.arange(len(LABELLERS))[::-1]
    return keys[:, None] // powers % 3 - 1


@dataclass(frozen=True)
class LabelModel:
    """``prior``: share of good documents; ``good``, ``bad``: for each labeller 1, then the chances of a bad and a good vote in that class."""

    prior: float
    good: np.ndarray
    bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = np.arange(votes.shape[1])
        a = np.log(self.prior) + np.log(self.good[at, votes + 1]).sum(1)
        b = np.log1p(-self.prior) + np.log(self.bad[at, votes + 1]).sum(1)
        return 1 / (1 + np.exp(np.clip(b - a, -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        return dict(zip(LABELLERS, (self.prior * self.good[:, 2] + (1 - self.prior) * self.bad[:, 1]).tolist()))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, p: QualityParams = QualityParams()) -> LabelModel:
    """Expectation-maximisation over vote patterns.  It starts from "bad where anyone says so"."""
    q = np.where((votes == 0).any(1), 0.1, 0.9)
    model = None
    for _ in range(p.em_steps):
        tables = []
        for w in (q * counts, (1 - q) * counts):
            said = np.stack([(w[:, None] * (votes == v)).sum(0) for v in (0, 1)], axis=1) + 1.0
            # no vote is no evidence: it has the factor 1 in both classes
            tables.append(np.hstack([np.ones((len(said), 1)), said / said.sum(1, keepdims=True)]))
        prior = float(np.clip((q * counts).sum() / counts.sum(), 1e-4, 1 - 1e-4))
        model = LabelModel(prior, *tables)
        before, q = q, model.posterior(votes)
        if np.abs(q - before).max() < p.tolerance:
            break
    return model


class Scorer:
    """Logistic scorer over hashed words and word pairs; a text's features are averaged, so length does not count."""

    def __init__(self, bits: int):
        self.bits, self.weights, self.bias = bits, np.zeros(1 << bits, np.float32), 0.0
        self.seen: dict[bytes, int] = {}

    def hashed(self, text: str | None) -> np.ndarray:
        words = text.encode().split() if text else []
        if not words:
            return np.zeros(0, np.int64)
        if len(self.seen) > 500_000:
            self.seen.clear()
        get, new = self.seen.get, xxhash.xxh64_intdigest
        values = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = get(w)
            if h is None:
                h = self.seen[w] = new(w)
            values[i] = h
        pairs = values[:-1] * np.uint64(0x9E3779B97F4A7C15) + values[1:]
        pairs ^= pairs >> np.uint64(31)
        return (np.concatenate([values, pairs * np.uint64(0xBF58476D1CE4E5B9)]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def score(self, text: str | None) -> float:
        h = self.hashed(text)
        z = float(self.weights[h].mean()) + self.bias if len(h) else self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def fit(self, texts: list[str | None], wanted: np.ndarray, p: QualityParams) -> None:
        """Stochastic gradient with a step for each feature that shrinks as the feature is seen (Adagrad)."""
        features = [self.hashed(t) for t in texts]
        power = np.full(1 << self.bits, 1e-8, np.float32)
        rng = np.random.default_rng(11)
        bias_power = 1e-8
        for _ in range(p.passes):
            for i in rng.permutation(len(features)):
                h = features[i]
                z = float(self.weights[h].mean()) + self.bias if len(h) else self.bias
                g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - wanted[i]
                bias_power += g * g
                self.bias -= p.rate * g / np.sqrt(bias_power)
                if len(h):
                    cells, times = np.unique(h, return_counts=True)
                    step = g * times / len(h)
                    power[cells] += step * step
                    self.weights[cells] -= p.rate * (step / np.sqrt(power[cells]) + p.decay * self.weights[cells])
        self.seen = {}


def with_votes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``votes``: the packed votes of every whole text."""

    @F.pandas_udf("int")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([vote_key(t if isinstance(t, str) else None) for t in texts], dtype=np.int32)

    return docs.withColumn("votes", packed(F.col(text)))


def fit(docs: DataFrame, p: QualityParams = QualityParams()) -> tuple[LabelModel, Scorer, DataFrame]:
    """Label model and scorer of ``(doc_id, text)``, and the table ``(doc_id, votes)`` of all documents.

    The pattern counts cover all documents; there are at most 3^8 patterns.  The scorer's sample is
    chosen by a hash of the id, half from patterns that lean good, half from those that lean bad.
    """
    voted = materialise(with_votes(docs.select("doc_id", "text")).select("doc_id", "votes"), "votes")
    found = voted.groupBy("votes").count().toPandas().sort_values("votes")
    scorer = Scorer(p.bits)
    if found.empty:
        return LabelModel(0.5, *[np.full((len(LABELLERS), 3), 1 / 3)] * 2), scorer, voted
    keys, counts = found["votes"].to_numpy(), found["count"].to_numpy().astype(float)
    model = fit_label_model(unpack(keys), counts, p)
    q = model.posterior(unpack(keys))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).cast("double") / 1e6
    chosen = F.lit(False)
    for side in (q >= 0.5, q < 0.5):
        share = min(1.0, p.sample_rows / 2 / max(1.0, counts[side].sum()))
        chosen = chosen | (F.col("votes").isin(keys[side].tolist()) & (draw < share))
    # bounded by the parameter, so it may be broadcast
    picked = F.broadcast(voted.where(chosen).limit(2 * p.sample_rows))
    rows = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "votes", "text").limit(4 * p.sample_rows).toPandas()
    rows = rows.sort_values(["doc_id", "votes", "text"])
    scorer.fit([t if isinstance(t, str) else None for t in rows["text"]], model.posterior(unpack(rows["votes"].to_numpy())), p)
    return model, scorer, voted


def classify(docs: DataFrame, model: LabelModel, scorer: Scorer, p: QualityParams = QualityParams(), text: str = "text") -> DataFrame:
    """``docs`` with ``votes``, ``label`` (posterior of the votes), ``score`` (of the scorer) and ``kept``.

    A document is kept when the mean of both reaches ``min_score``.  Null and empty texts have one vote, bad, and
    no words, so they get the scorer's bias and are not kept.  Columns of the same names are replaced.
    """
    added = ("votes", "label", "score", "kept")
    shared = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias, scorer.bits))

    @F.pandas_udf("votes int, label double, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, bias, bits = shared.value
        own = Scorer(bits)
        own.weights, own.bias = weights, bias
        for texts in parts:
            texts = [t if isinstance(t, str) else None for t in texts]
            keys = np.array([vote_key(t) for t in texts], dtype=np.int64)
            yield pd.DataFrame({"votes": keys.astype(np.int32), "label": model.posterior(unpack(keys)), "score": [own.score(t) for t in texts]})

    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(*kept, judge(F.col(text)).alias("_judged")).select(*kept, "_judged.*")
    has_word = F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))
    return rows.withColumn("kept", has_word & (((F.col("label") + F.col("score")) / 2) >= p.min_score))


def agreement(scored: DataFrame, truth: DataFrame, label: Column) -> DataFrame:
    """Documents by true label and verdict, for a look at held-out rows."""
    return scored.join(truth, "doc_id").groupBy(label.alias("truth"), "kept").count()


# workers get this module's functions with the task, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
