"""Language by a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window, the strongest answer of each is
kept (max pooling) and a softmax layer turns those into languages.  The network is trained in NumPy on a
bounded sample of labelled windows.  A text is cut into windows that cover all of it; its prediction is the
mean over them, weighted by their bytes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    """``rows_per_language`` bounds the labelled texts that the network is fitted on (about that many of each)."""

    rows_per_language: int = 1200
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8  # of each width
    embedding: int = 8
    steps: int = 500
    batch: int = 96
    rate: float = 0.01
    min_score: float = 0.5  # what the pipeline asks for


class ByteNet:
    """Embedding, convolutions, max pooling, softmax.  Narrower filters are wider ones with zero weights."""

    def __init__(self, labels: list[str], p: LanguageParams):
        rng = np.random.default_rng(3)
        self.labels, self.window, self.width = labels, p.window, max(p.widths)
        n = p.filters * len(p.widths)
        self.mask = np.zeros((self.width, p.embedding, n), np.float32)
        for j, w in enumerate(p.widths):
            self.mask[:w, :, j * p.filters : (j + 1) * p.filters] = 1
        self.mask = self.mask.reshape(-1, n)
        self.embedding = rng.normal(0, 0.5, (256, p.embedding)).astype(np.float32)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.top = rng.normal(0, 0.3, (n, len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), np.float32)

    def pooled(self, windows: np.ndarray, places: bool = False):
        """Strongest answer of every filter in every window of bytes ``(n, window)``, and where it was."""
        size = self.width * self.embedding.shape[1]
        best, where = [], []
        for part in np.array_split(windows, max(1, len(windows) // 32)):
            e = self.embedding[part].reshape(len(part), -1)
            views = sliding_window_view(e, size, axis=1)[:, :: self.embedding.shape[1]]
            answers = (np.ascontiguousarray(views).reshape(-1, size) @ self.filters).reshape(len(part), -1, self.filters.shape[1])
            best.append(answers.max(1))
            if places:
                where.append(answers.argmax(1))
        return (np.concatenate(best), np.concatenate(where) if places else None)

    def forward(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.top + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        return self.forward(self.pooled(windows)[0])

    def train(self, windows: np.ndarray, wanted: np.ndarray, p: LanguageParams) -> None:
        """Adam on the cross entropy; the gradient reaches only the bytes under each filter's strongest answer."""
        rng = np.random.default_rng(5)
        names = ("embedding", "filters", "bias", "top", "offset")
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        groups = [np.flatnonzero(wanted == c) for c in range(len(self.labels))]
        size = self.embedding.shape[1]
        for step in range(1, p.steps + 1):
            rows = np.concatenate([rng.choice(g, -(-p.batch // len(groups))) for g in groups])
            x, y = windows[rows], wanted[rows]
            best, where = self.pooled(x, places=True)
            hidden = np.maximum(best + self.bias, 0)
            d = self.forward(best)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            back = (d @ self.top.T) * (hidden > 0)
            spots = where[:, :, None] + np.arange(self.width)
            under = x[np.arange(len(x))[:, None, None], spots]  # (rows, filters, width) bytes
            seen = self.embedding[under].reshape(len(x), -1, self.width * size)
            grad = {"top": hidden.T @ d, "offset": d.sum(0), "bias": back.sum(0), "filters": np.einsum("nf,nfk->kf", back, seen) * self.mask}
            grad["embedding"] = np.zeros_like(self.embedding)
            np.add.at(grad["embedding"], under, (back[:, :, None] * self.filters.T[None]).reshape(*under.shape, size))
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grad[n]
                second[n] = 0.999 * second[n] + 0.001 * grad[n] ** 2
                move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(self, n, (getattr(self, n) - p.rate * move).astype(np.float32))


def windows_of(data: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes as rows of a fixed length, the last one filled up with zeros, and the bytes in each."""
    n = -(-len(data) // window)
    out = np.zeros(n * window, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, window)
    sizes[-1] = len(data) - (n - 1) * window
    return out.reshape(n, window), sizes


def has_letter(text: Column | str) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, p: LanguageParams = LanguageParams()) -> ByteNet:
    """Train on ``(id, text, lang)``: about ``rows_per_language`` texts of each language, chosen by a hash of the id.

    Rows without text, letter or language teach nothing.  Of a chosen text one window at a hashed place is
    fetched.  Without any labelled row the network has no label and every text is ``und``.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    labels = sorted(sizes)
    if not labels:
        return ByteNet([], p)
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double") / 1e6
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, p.rows_per_language / n)).otherwise(share)
    at = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.length("text") - p.window + 1, F.lit(1))) + 1
    sample = rows.where(draw < share).where(has_letter("text")).select("id", "lang", F.substring("text", at.cast("int"), F.lit(p.window)).alias("text")).toPandas()
    sample = sample.sort_values(["id", "text"])
    net = ByteNet([x for x in labels if (sample["lang"] == x).any()], p)
    if len(net.labels) > 1:
        x = np.stack([windows_of(t.encode()[: p.window], p.window)[0][0] for t in sample["text"]])
        net.train(x, sample["lang"].map(net.labels.index).to_numpy(), p)
    return net


def predict(docs: DataFrame, net: ByteNet, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) of every whole text.

    Null texts and texts without a letter get ``und`` and 0.  Ties go to the label that sorts first.  Columns
    of the same two names are replaced.
    """
    labels, window = net.labels, net.window

    @F.pandas_udf("lang_pred string, score double")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            chosen = [(i, t.encode()) for i, t in enumerate(texts) if isinstance(t, str) and labels]
            for i, data in chosen:
                total, size = np.zeros(len(labels)), 0
                for start in range(0, len(data), window << 12):  # bounded memory, also for very long texts
                    rows, sizes = windows_of(data[start : start + (window << 12)], window)
                    total += sizes @ net.predict(rows)
                    size += sizes.sum()
                total /= size
                names[i], scores[i] = labels[int(total.argmax())], min(1.0, float(total.max()))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    lettered = F.when(has_letter(text), F.col(text))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, guess(lettered).alias("_guess")).select(*kept, "_guess.lang_pred", "_guess.score")


# workers get this module's functions with the task, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
