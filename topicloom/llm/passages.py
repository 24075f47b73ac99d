"""Passages that repeat across documents, also with changes.

Every text is reduced to a sample of its word k-mers, chosen by their hashes alone, so that what changes beside a k-mer
doesn't unselect it; k-mers are short, since a passage of which four words in five agree may have no longer ones.  Documents with
equal word sequences form one class first.  A class is paired with the first class of each of its seeds when
they share two or more, and with the first class that holds each run of ``min_words`` words it has; these runs are compared only
around spans of words that begin at the smallest k-mer of a window and that several classes hold.  Seeds that lie in none of the
passages found so are open: a class is then paired with every earlier class, first or not, that has two of its open seeds near each
other with other words between them, and with the first that has two with the same words between, which are one
piece of evidence.  For a pair all shared k-mers of the whole texts are found, equal neighbours
are joined into runs, and the runs are chained: a chain moves forward in both texts and pays for gaps, and a
Fenwick tree over the places in the second text gives the best chain that a run can extend.  The gaps inside a
chain are aligned, and the longest parts of a chain of which most words agree are its passages.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.runtime import discard, materialise

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LOW_BITS = np.uint64(0xFFFF)
BLANKS = b" \t\n\r\x0b\x0c"
IS_BLANK = bytes(b in BLANKS for b in range(256))
LOWERED = bytes(range(256)).lower()
INVERSE = np.uint64(pow(int(GOLDEN), -1, 1 << 64))
PREFIX = np.uint64(0xFFFFFFFF)
ROW_BITS = 40  # a place in a batch is the row above these bits and the place in its text below


@dataclass(frozen=True)
class PassageParams:
    k: int = 4  # 40 of 50 words leave at least one run of four between ten changes
    sample: int = 4  # one k-mer of so many is a seed, by its hash alone
    window: int = 16
    shared: int = 2
    min_words: int = 50
    min_agreement: float = 0.8
    gap_cost: float = 0.05
    near: int = 16  # occurrences in the other text that a repeated k-mer meets
    chunk: int = 1024  # classes that one task compares with their first; also those of two seeds that meet in one place


class Words(dict[bytes, int]):
    """Hashes of words, kept from text to text."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(self) > 400_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache(1)
def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(1).integers(0, 1 << 64, n, np.uint64)


def compared_words(text: bytes) -> np.ndarray:
    """The words of a text, A-Z lowered, by numbers that tell them apart: the sum of their bytes, each times a random number of
    its place.  All words are numbered together; these are not the hashes that choose seeds."""
    blank = np.frombuffer((b" " + text + b" ").translate(IS_BLANK), bool)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    if not len(edges):
        return np.empty(0, np.uint64)
    sizes = edges[1::2] - edges[::2]
    begin = np.cumsum(sizes) - sizes
    letters = np.frombuffer(text.translate(LOWERED, BLANKS), np.uint8)
    place = np.arange(len(letters)) - np.repeat(begin, sizes)
    factors = multipliers(1 << max(10, int(sizes.max()).bit_length())).take(place)
    return np.add.reduceat((letters + np.uint64(1)) * factors, begin)


def k_mers(words: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(words) - k + 1)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = total * GOLDEN + words[j : j + n]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
    return total


def seeds(hashes: np.ndarray, window: int) -> np.ndarray:
    """The distinct smallest hashes of all windows; of the whole where it is shorter than one."""
    if len(hashes) <= window:
        return hashes.min(keepdims=True) if len(hashes) else hashes
    low, size = hashes, 1
    while size * 2 <= window:  # minima over 2, 4, 8 ... neighbours
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < window:
        low = np.minimum(low[: len(hashes) - window + 1], low[window - size :])
    return np.unique(low)


def among(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which values are among the chosen, which ascend."""
    if not len(chosen):
        return np.zeros(len(values), bool)
    return chosen[np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)] == values


def spans(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all spans of ``n`` words, from those of 1, 2, 4 ... words."""
    mix = lambda x, y, k: ((x * GOLDEN + y) ^ ((x + np.uint64(k)) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    if len(words) < n:
        return np.empty(0, np.uint64)
    out, size = words, 1
    while size * 2 <= n:
        out, size = mix(out[:-size], out[size:], size), size * 2
    return out if size == n else mix(out[: len(words) - n + 1], out[n - size :], n)


def anchored(words: np.ndarray, hashes: np.ndarray, chosen: np.ndarray, p: PassageParams) -> tuple[np.ndarray, np.ndarray]:
    """Places of the seeds and hashes of the spans that begin there.

    The first window of an unchanged run of ``min_words`` words has its seed in the run, and ``min_words - window + 1`` words from
    there on are in the run too, so both documents of the run hold this span.
    """
    long = spans(words, p.min_words - p.window + 1)
    places = np.flatnonzero(among(hashes, chosen))
    places = places[places < len(long)]
    return places, long[places]


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    """Modulo 2**64; the first is 1."""
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])


def powers_of(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    return powers(int(base), 1 << max(12, int(exponents.max(initial=0)).bit_length())).take(exponents)


def seed_spots(words: np.ndarray, hashes: np.ndarray, p: PassageParams) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a text and their spots: the place above 32 bits of a sum over the words before it, each times a power of its place, so
    that two spots tell what lies between them.  All bits of a spot are turned where its seed came before."""
    at = np.flatnonzero(hashes % np.uint64(p.sample) == 0)
    scaled = words * powers_of(GOLDEN, np.arange(len(words)))
    before = (np.cumsum(scaled) - scaled)[at]
    spots = at << 32 | (before & PREFIX).astype(np.int64)
    again = np.ones(len(at), bool)
    again[np.unique(hashes[at], return_index=True)[1]] = False
    return hashes[at], np.where(again, ~spots, spots)


SIGNED = "doc_id bigint, n_words bigint, low bigint, high bigint, seeds array<struct<key:bigint,spot:bigint>>, anchors array<bigint>"


def listed(arrays: list[np.ndarray], *others: list[np.ndarray]) -> pa.ListArray:
    """Lists of numbers, or of structs of a key and a spot."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (arrays, *others)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["key", "spot"]) if others else columns[0])


def sign(p: PassageParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                every = [words.of((t.as_py() or "").encode()) for t in part.column(1)]
                digests = [xxhash.xxh128_intdigest(w.tobytes()) for w in every]
                hashes = [k_mers(w, p.k) for w in every]
                found, spots = zip(*(seed_spots(w, h, p) for w, h in zip(every, hashes)))
                long = [np.unique(anchored(w, h, seeds(h, p.window), p)[1]) for w, h in zip(every, hashes)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(w) for w in every], pa.int64()),
                        pa.array(np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64).view(np.int64)),
                        pa.array(np.array([d >> 64 for d in digests], np.uint64).view(np.int64)),
                        listed(found, spots),
                        listed(long),
                    ],
                    names=["doc_id", "n_words", "low", "high", "seeds", "anchors"],
                )

    return run


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, text)`` with the text as its length and compressed bytes: a text travels once for each of its pairs."""
    for batch in batches:
        plain = [None if t is None else t.encode() for t in batch.column(1).to_pylist()]
        texts = [None if t is None else len(t).to_bytes(8) + pa.compress(t, "zstd", asbytes=True) for t in plain]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["node", "text"])


def unsqueezed(text: pa.Scalar) -> bytes:
    if not text.is_valid:
        return b""
    size, packed = int.from_bytes((whole := text.as_py())[:8]), whole[8:]
    return pa.decompress(packed, size, "zstd", asbytes=True)


RUNS = "node bigint, run bigint"


def exact_runs(p: PassageParams):
    """Of ``(node, text, anchors)``: every run of ``min_words`` words that holds one of the anchors at the place of a seed in its first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for node, text, shared in zip(batch.column("node").to_numpy(), batch.column("text"), batch.column("anchors")):
                w = words.of(unsqueezed(text))
                hashes, whole = k_mers(w, p.k), spans(w, p.min_words)
                places, long = anchored(w, hashes, seeds(hashes, p.window), p)
                places = places[among(long, np.sort(shared.values.to_numpy().view(np.uint64)))]
                # a run may start at a place or at one of the window before it
                starts = np.cumsum(np.bincount(np.maximum(places - p.window + 1, 0), minlength=len(w) + 1) - np.bincount(places + 1, minlength=len(w) + 1))
                found = np.unique(whole[starts[: len(whole)] > 0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node, np.int64)), pa.array(found.view(np.int64))], names=["node", "run"])

    return run


class Held:
    """A text that others are compared with, and where its k-mers are."""

    def __init__(self, words: np.ndarray, p: PassageParams):
        self.p, self.words = p, words
        hashes = spans(self.words, p.k)
        self.places = np.argsort(hashes, kind="stable")
        ascending = hashes[self.places]
        self.start = np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])[: len(hashes)])
        self.k_mers, self.count = ascending[self.start], np.diff(np.append(self.start, len(hashes)))
        self.ends = np.zeros(int(LOW_BITS) + 1, bool)  # low bits of its k-mers; most others are told by them
        self.ends[hashes & LOW_BITS] = True

    @cached_property
    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """The runs of ``min_words`` words in ascending order, and the first place of each."""
        return np.unique(spans(self.words, self.p.min_words), return_index=True)


def equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many words are equal before the first that differs."""
    n, done, step = min(len(a), len(b)), 0, 32
    while done < n:
        differ = a[done : min(n, done + step)] != b[done : min(n, done + step)]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, step = done + step, 4 * step
    return n


def extended(i: int, j: int, n: int, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """A run with the equal words before and behind it."""
    before = equal_ahead(a[:i][::-1], b[:j][::-1]) if i and j and a[i - 1] == b[j - 1] else 0
    return i - before, j - before, before + n + equal_ahead(a[i + n :], b[j + n :])


def runs_of(words: np.ndarray, held: Held, p: PassageParams) -> list[tuple[int, int, int]]:
    """Maximal runs ``(place, other place, words)`` of shared k-mers.

    A k-mer meets every occurrence in the other text, or, where it has more than ``near`` of them, those nearest in order.
    A run is grown word by word past k-mers that have met other occurrences only.
    """
    hashes = spans(words, p.k)
    if not len(hashes) or not len(held.k_mers):
        return []
    place = np.flatnonzero(held.ends[hashes & LOW_BITS])
    at = np.minimum(np.searchsorted(held.k_mers, hashes[place]), len(held.k_mers) - 1)
    same = held.k_mers[at] == hashes[place]
    place, at = place[same], at[same]
    if not len(place):
        return []
    start, count = held.start[at], held.count[at]
    if many := bool((count > p.near).any()):
        order = np.argsort(at, kind="stable")
        nth = np.empty(len(at), np.int64)
        nth[order] = np.arange(len(at)) - np.searchsorted(at[order], at[order], "left")
        met = np.minimum(count, p.near)
        start, count = start + np.clip(nth - p.near // 2, 0, count - met), met
    i = np.repeat(place, count)
    j = held.places[np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())]
    order = np.argsort((i - j) * len(words) + i)  # by diagonal, then by place
    i, j = i[order], j[order]
    at = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    size = np.diff(np.append(at, len(i))) + p.k - 1
    runs = list(zip(i[at].tolist(), j[at].tolist(), size.tolist()))
    if many:
        grown: list[tuple[int, int, int]] = []
        for x, y, n in runs:
            if not (grown and grown[-1][0] - grown[-1][1] == x - y and x + n <= grown[-1][0] + grown[-1][2]):
                grown.append(extended(x, y, n, words, held.words))
        runs = grown
        # each run of min_words, which may have met other occurrences throughout, with its first place in the other text
        whole, (whole_other, first) = spans(words, p.min_words), held.runs
        at = np.minimum(np.searchsorted(whole_other, whole), len(first) - 1)
        same = np.flatnonzero(whole_other[at] == whole) if len(first) else np.empty(0, np.int64)
        last = None
        for x, y in zip(same.tolist(), first[at[same]].tolist() if len(same) else []):
            if last is None or last[0] - last[1] != x - y or x + p.min_words > last[0] + last[2]:
                last = extended(x, y, p.min_words, words, held.words)
                runs.append(last)
    return sorted(set(runs))


class Fenwick:
    """Largest value so far at or below a place."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def get(self, place: int) -> tuple[float, int]:
        out = (0.0, -1)
        while place > 0:
            if self.best[place] > out:
                out = self.best[place]
            place -= place & -place
        return out


def chains(runs: list[tuple[int, int, int]], p: PassageParams) -> list[list[tuple[int, int, int]]]:
    """Collinear chains, the best first; a run belongs to one chain.

    A run extends the best chain that ends before it in both texts.  The cost of a gap is a share of the words
    between, so the part that depends on the earlier run alone is what the tree keeps.
    """
    ends = sorted({j + n for _, j, n in runs})
    rank = {e: r for r, e in enumerate(ends)}
    tree, score, previous = Fenwick(len(ends)), [0.0] * len(runs), [-1] * len(runs)
    waiting = sorted(range(len(runs)), key=lambda r: runs[r][0] + runs[r][2])
    done = 0
    for r, (i, j, n) in enumerate(runs):
        while done < len(waiting) and runs[waiting[done]][0] + runs[waiting[done]][2] <= i:
            q = waiting[done]
            qi, qj, qn = runs[q]
            tree.put(rank[qj + qn], (score[q] + p.gap_cost * (qi + qn + qj + qn), q))
            done += 1
        low, high = 0, len(ends)
        while low < high:  # ends at or before this run's start
            mid = (low + high) // 2
            low, high = (mid + 1, high) if ends[mid] <= j else (low, mid)
        value, q = tree.get(low)
        gain = value - p.gap_cost * (i + j)
        score[r], previous[r] = (n + gain, q) if q >= 0 and gain > 0 else (float(n), -1)
    used, out = [False] * len(runs), []
    for r in sorted(range(len(runs)), key=lambda r: -score[r]):
        chain = []
        while r >= 0 and not used[r]:
            used[r] = True
            chain.append(runs[r])
            r = previous[r]
        if chain:
            out.append(chain[::-1])
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words that an alignment of two gaps can match: their longest common subsequence, a bit for each word of the first."""
    if not len(a) or not len(b):
        return 0
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        hit = row & places.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def aligned(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray, p: PassageParams) -> list[tuple[int, int, int, int, int]]:
    """``(start, end, other start, other end, matched)`` of the parts of a chain that are passages.

    The longest part of which enough words agree is one, then the longest of what lies before and behind it, and so on.  A run
    of ``min_words`` is such a part itself, so none is lost to what it was chained with.
    """
    (i, j, n), (x, y, m) = chain[0], chain[-1]
    if max(x + m - i, y + m - j) < p.min_words:
        return []
    if len(chain) == 1:
        return [(i, i + n, j, j + n, n)]
    # a gap with too few words to agree in the whole chain is in no passage, so most are not aligned
    between = sum(min(x - u - m, y - v - m) for (u, v, m), (x, y, _) in zip(chain, chain[1:]))
    if sum(run[2] for run in chain) + between < p.min_agreement * p.min_words:
        return []
    i, j, n = np.array(chain, np.int64).T
    inside = np.array([common_words(a[u + m : x], b[v + m : y]) for (u, v, m), (x, y, _) in zip(chain, chain[1:])], np.int64)
    upto = np.cumsum(n + np.concatenate([[0], inside]))  # matched words from the start to the end of each run
    out, todo = [], [(0, len(chain))]
    while todo:
        low, high = todo.pop()
        best = (0, low, low)
        for s in range(low, high):
            longest = np.maximum(i[s:high] + n[s:high] - i[s], j[s:high] + n[s:high] - j[s])
            matched = upto[s:high] - upto[s] + n[s]
            good = np.flatnonzero((longest >= p.min_words) & (matched >= p.min_agreement * longest))
            if len(good) and longest[good[-1]] > best[0]:
                best = (int(longest[good[-1]]), s, s + int(good[-1]) + 1)
            if max(i[high - 1] + n[high - 1] - i[s], j[high - 1] + n[high - 1] - j[s]) <= best[0]:
                break  # nothing that starts later is longer
        if best[0]:
            _, s, e = best
            out.append((int(i[s]), int(i[e - 1] + n[e - 1]), int(j[s]), int(j[e - 1] + n[e - 1]), int(upto[e - 1] - upto[s] + n[s])))
            todo += [(low, s), (e, high)]
    return out


def outermost(passages: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Passages whose words in the document are not all in a longer one: text that repeats inside the other document counts once."""
    kept, reach = [], -1
    for x in sorted(passages, key=lambda x: (x[0], -x[1], -x[4], x[2])):
        if x[1] > reach:
            kept.append(x)
            reach = x[1]
    return kept


FOUND = "doc_id bigint, other_id bigint, start bigint, end bigint, other_start bigint, other_end bigint, matched bigint"


def chain_pairs(p: PassageParams):
    """Rows come sorted by first class and chunk, the first's own text before the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            out = []
            for first, node, text in zip(batch.column("first").to_pylist(), batch.column("node").to_pylist(), batch.column("text")):
                w = compared_words(unsqueezed(text))
                if node == first:
                    at, held = first, Held(w, p)
                    continue
                assert at == first
                every = [x for chain in chains(runs_of(w, held, p), p) for x in aligned(chain, w, held.words, p)]
                out += [(node, first, *passage) for passage in outermost(every)]
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def first_holders(nodes: DataFrame, node: str, key: Column, shared: int) -> DataFrame:
    """``(first, node)``: each node with every other that is the first with ``shared`` of its keys."""
    each = nodes.select(F.col(node).alias("node"), key.alias("key"))
    firsts = each.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    pairs = each.join(firsts, "key").where("first <> node").groupBy("first", "node").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.where(F.col("shared") >= shared).select("first", "node")


def held_by_several(each: DataFrame, key: str) -> DataFrame:
    """Rows ``(key, node, low ..)`` whose key several classes hold, with the ``first`` of its nodes.  One shuffle by key, and no row travels
    with its text's other keys."""
    same = Window.partitionBy(key)
    found = each.withColumns({"first": F.min("node").over(same), "_low": F.min("low").over(same), "_high": F.max("low").over(same)})
    return found.where("_low < _high").drop("_low", "_high", "low")


def open_places(node_seeds: pa.Array, spans_: pa.Array, p: PassageParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in a batch in ascending order, their seeds, the sums before them, and whether they are open.

    Open are places whose seed an earlier document has, which lie in none of the passages (``spans_``) of their text, and near which another is.
    """
    parts = node_seeds.flatten()
    key, spot = parts.field("key").to_numpy(zero_copy_only=False), parts.field("spot").to_numpy(zero_copy_only=False)
    spot = np.where(spot < 0, ~spot, spot)
    row = np.repeat(np.arange(len(node_seeds)), node_seeds.value_lengths().to_numpy(zero_copy_only=False))
    place = row << ROW_BITS | spot >> 32
    order = np.argsort(place, kind="stable")
    place, key, before = place[order], key[order], spot[order].view(np.uint64) & PREFIX
    found = spans_.flatten()
    base = np.repeat(np.arange(len(spans_)), spans_.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) << ROW_BITS
    start, end = (base | found.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
    by_start = np.argsort(start, kind="stable")
    reach = np.concatenate([[-1], np.maximum.accumulate(end[by_start])])  # of the spans that start no later
    covered = reach[np.searchsorted(start[by_start], place, "right")] >= place + p.k
    is_open = parts.field("later").to_numpy(zero_copy_only=False)[order] & ~covered
    at = np.flatnonzero(is_open)
    near = np.diff(place[at]) <= p.min_words
    is_open[at] = np.concatenate([[False], near]) | np.concatenate([near, [False]]) if len(at) else False
    return place, key, before, is_open


def open_keys(p: PassageParams):
    """Of ``(node, seeds, spans)``: the seeds at open places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, key, _, is_open = open_places(batch.column("seeds"), batch.column("spans"), p)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[is_open]))], names=["key"])

    return run


NEAR_SEEDS = "node bigint, pair bigint, between bigint, open boolean"


def near_seeds(p: PassageParams):
    """Of ``(node, seeds, spans)``: every two seeds within ``min_words`` words, and a hash of the words from the one to the other; open
    where both places are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, key, before, is_open = open_places(batch.column("seeds"), batch.column("spans"), p)
            node, hashed, out = batch.column("node").to_numpy(), key.view(np.uint64), []
            left = np.arange(len(place))
            for step in range(1, len(place)):
                left = left[left + step < len(place)]
                left = left[place[left + step] - place[left] <= p.min_words]  # nothing further off is nearer
                if not len(left):
                    break
                a = left[key[left] != key[left + step]]
                b = a + step
                pair = (hashed[a] * GOLDEN + hashed[b]) * np.uint64(0xBF58476D1CE4E5B9)
                inside = place[a] & ((1 << ROW_BITS) - 1)
                between = ((before[b] - before[a]) * powers_of(INVERSE, inside) & PREFIX).astype(np.int64)
                out.append((place[a] >> ROW_BITS, pair.view(np.int64), between, is_open[a] & is_open[b]))
            if not out:
                continue
            row, pair, between, both = map(np.concatenate, zip(*out))
            order = np.lexsort((~both, between, pair, row))  # each once, open if it is so anywhere
            row, pair, between, both = row[order], pair[order], between[order], both[order]
            new = np.concatenate([[True], (np.diff(row) != 0) | (pair[1:] != pair[:-1]) | (np.diff(between) != 0)])
            yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (node[row], pair, between, both)], names=["node", "pair", "between", "open"])

    return run


def open_pairs(shared: DataFrame, found: DataFrame, nodes: DataFrame, p: PassageParams) -> DataFrame:
    """``(first, node)``: each of ``nodes`` with the earlier ones that may explain what the passages found leave open.

    Those are all earlier nodes that have two open seeds of the node near each other with other words between, and the first with the same words
    between.  Nodes of two seeds that very many have meet in parts of about ``chunk`` of them.
    """
    covered = found.groupBy(F.col("doc_id").alias("node")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def by_node(rows: DataFrame) -> DataFrame:
        parts = rows.groupBy("node").agg(F.collect_list(F.struct("key", "spot", (F.col("first") < F.col("node")).alias("later"))).alias("seeds"))
        return parts.join(nodes.hint("merge"), "node", "left_semi").join(covered.hint("merge"), "node", "left").select("node", "seeds", "spans")

    keys = materialise(by_node(shared.where("first < node")).mapInArrow(open_keys(p), "key bigint").distinct(), "open-keys")
    near = materialise(by_node(shared.join(keys, "key", "left_semi")).mapInArrow(near_seeds(p), NEAR_SEEDS), "near-seeds")
    discard(keys)
    held = near.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.max("open").alias("any"), (F.min("between") < F.max("between")).alias("several"))
    held = held.where(F.col("any") & (F.col("low") < F.col("high"))).select("pair", "several", F.ceil(F.col("n") / p.chunk).cast("int").alias("parts"))
    rows = materialise(near.join(held, "pair"), "open-seeds")
    discard(near)
    differ = rows.where("several")  # with the same words between everywhere, no two differ
    mine = differ.where("open").select("pair", "node", F.col("between").alias("own"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    others = differ.select("pair", F.col("node").alias("first"), "between", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    every = mine.join(others.hint("merge"), ["pair", "part"]).where("first < node AND between <> own").select("first", "node").distinct()
    same = rows.groupBy("pair", "between").agg(F.min("node").alias("first"))
    same = rows.where("open").join(same.hint("merge"), ["pair", "between"]).where("first < node").select("first", "node")
    pairs = materialise(every.union(same).distinct(), "open-pairs")
    discard(rows)
    return pairs


def squeezed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    texts = docs.withColumnRenamed("doc_id", "node").join(wanted.hint("merge"), "node", "left_semi")
    texts = texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(squeezed, "node bigint, text binary")
    return materialise(texts, "seed-texts")


def compared(pairs: DataFrame, texts: DataFrame, p: PassageParams) -> DataFrame:
    """The passages of ``pairs (first, node)``."""
    sizes = pairs.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / p.chunk).cast("int").alias("chunks"))
    members = pairs.join(sizes, "first").select("first", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    own = sizes.select("first", F.col("first").alias("node"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows = members.union(own).hint("merge").join(texts, "node").select("first", "chunk", "node", "text")
    rows = rows.repartition("first", "chunk").sortWithinPartitions("first", "chunk", F.col("node") != F.col("first"))
    return rows.mapInArrow(chain_pairs(p), FOUND)


def repeated_passages(docs: DataFrame, p: PassageParams = PassageParams()) -> DataFrame:
    """Passages of ``min_words`` or more shared by two documents of ``(doc_id, text)``.

    One row for each passage: the spans of words in ``doc_id`` and in ``other_id``, the smaller one, and how many words agree;
    ``exact_copy`` where both texts have the same words throughout.  Copies are linked with the first of them only,
    and other documents with the first document of each of their seeds and of each of their runs of ``min_words`` words, so a
    passage in many documents gives one row for each of those but the first, and every unchanged run of ``min_words`` words that an
    earlier document holds is in a passage.  What these passages leave open of a document is compared with all earlier documents that share
    two of its seeds there (see ``open_pairs``).  Null, empty and shorter texts have no passage; rows that repeat an id count once;
    null ids take no part; other columns are ignored.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    stored = materialise(docs.mapInArrow(sign(p), SIGNED), "seeds")
    long = stored.where(F.col("n_words") >= p.min_words * p.min_agreement)
    signed = materialise(long.drop("seeds", "anchors"), "signed")
    classes = signed.groupBy("low", "high").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = classes.select(F.col("first").alias("node"))
    tag = F.shiftright("low", 32).cast("int").alias("low")  # tells classes apart
    shared = materialise(held_by_several(long.select(F.col("doc_id").alias("node"), tag, F.inline("seeds")), "key"), "seed-holders")
    counted = shared.where("first <> node AND spot >= 0").groupBy("first", "node").agg(F.count(F.lit(1)).alias("shared"))
    fuzzy = counted.where(F.col("shared") >= p.shared).select("first", "node").join(nodes, "node", "left_semi")
    fuzzy = materialise(fuzzy.select("first", "node"), "seed-pairs")
    # runs of min_words are compared only around spans that several documents hold
    spans_ = held_by_several(long.select(F.col("doc_id").alias("node"), tag, F.explode("anchors").alias("anchor")), "anchor")
    held = spans_.groupBy("node").agg(F.collect_list("anchor").alias("anchors")).join(nodes.hint("merge"), "node", "left_semi")
    held = materialise(held, "anchors")
    discard(stored)  # the largest table; it would lie beside the texts
    texts = squeezed_texts(docs, fuzzy.select("node").union(fuzzy.select("first")).union(held.select("node")).distinct())
    runs = materialise(texts.join(held.hint("merge"), "node").select("node", "text", "anchors").mapInArrow(exact_runs(p), RUNS), "runs")
    exact = first_holders(runs, "node", F.col("run"), 1)
    first_pairs = materialise(fuzzy.union(exact).distinct(), "first-pairs")
    for table in (fuzzy, held, runs):
        discard(table)
    known = materialise(compared(first_pairs, texts, p), "passages")
    discard(texts)
    others = open_pairs(shared, known, nodes, p)
    new = others.join(first_pairs, ["first", "node"], "left_anti").select(F.col("node").alias("doc_id"), F.col("first").alias("other_id"))
    pairs = materialise(known.unionByName(new, allowMissingColumns=True), "pairs")  # with their passages, or yet to be compared
    for table in (shared, first_pairs, known, others):
        discard(table)
    new = pairs.where("start IS NULL").select(F.col("other_id").alias("first"), F.col("doc_id").alias("node"))
    texts = squeezed_texts(docs, new.select("node").union(new.select("first")).distinct())
    found = pairs.where("start IS NOT NULL").union(compared(new, texts, p)).withColumn("exact_copy", F.lit(False))
    copies = signed.where(F.col("n_words") >= p.min_words).join(classes.where("n > 1"), ["low", "high"]).where("doc_id <> first").select("doc_id", "first", "n_words").distinct()
    zero = F.lit(0).cast("long")
    whole = copies.select("doc_id", F.col("first").alias("other_id"), zero.alias("start"), F.col("n_words").alias("end"), zero.alias("other_start"), F.col("n_words").alias("other_end"), F.col("n_words").alias("matched"), F.lit(True).alias("exact_copy"))
    return found.union(whole)


# workers get this module's functions with the task, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
