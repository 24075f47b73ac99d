"""Subword ids of a given SentencePiece model (byte pair merges with byte fallback), and back.

No piece of such a model runs across the start of a word, so a text falls into words that are encoded on
their own, and the distinct new words of a batch are encoded together: their concatenated bytes get a suffix
array, a binary search finds the range of suffixes that start with each piece, and every hit is an edge
from its start to its end.  The edges are sorted by position and relaxed: an edge extends what ends at its
start if merging would leave that last piece and the new one apart.  A row of pieces is what the merges
give exactly when each neighbouring two of them are, so every position is reached by one edge.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # how a model writes a blank
STOP, NUL, NO_PIECE = 0xFF, 0xFE, 0xFFFF  # bytes that UTF-8 never has; a number that no piece has
# none of these changes a result; they bound what a worker process holds, and an idle one keeps it
BATCH_BYTES = 1 << 18  # words encoded together
TEXT_BYTES = 1 << 20  # texts split together
KEPT_WORDS = 100_000  # of each of two generations
KEPT_PAIRS = 500_000


@dataclass(frozen=True)
class PieceModel:
    """What the driver reads from a model file; its size is that of the vocabulary."""

    pieces: tuple[bytes, ...]  # blank as b" "; b"" where an id stands for no text
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]  # id of each of the 256 bytes


def load(path: str) -> PieceModel:
    """Read a model file; raises where its pieces don't allow words to be encoded on their own."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids, pieces = [-1] * 256, []
    for i in range(n):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        pieces.append(name.replace(SPACE, " ").encode() if plain else b"")
    known = set(pieces)
    if min(byte_ids) < 0 or n >= NO_PIECE or b" " not in known:
        raise ValueError("the model needs a piece for every byte and for the blank, and fewer than 65,535 pieces")
    for p in pieces:
        if b" " in p[1:] and p.strip(b" ") or any(c.encode() not in known for c in p.decode()):
            raise ValueError(f"piece {p!r} crosses the start of a word or has a character that is no piece")
    worst = min(s for s, p in zip((model.get_score(i) for i in range(n)), pieces) if p.strip(b" "))
    if any(model.get_score(i) > worst for i, p in enumerate(pieces) if len(p) > 1 and not p.strip(b" ")):
        raise ValueError("runs of blanks must merge last")
    return PieceModel(tuple(pieces), tuple(model.get_score(i) for i in range(n)), tuple(byte_ids))


class Encoder:
    """Encodes batches of words; keeps the ids of words it has seen lately, up to a bound.

    Words are kept in two generations: when the newer one is full it becomes the older one, whose words are
    taken over as they are met again and go with it otherwise.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.id_of = {p: i for i, p in enumerate(model.pieces) if p}
        order = sorted({-model.scores[i] for i in self.id_of.values()})
        place = {score: n - len(order) for n, score in enumerate(order)}  # negative, the best first; 0: no piece
        self.rank = {p.decode(): place[-model.scores[i]] for p, i in self.id_of.items()}
        self.ids = np.array(sorted(self.id_of.values()), np.int64)
        self.length = np.array([len(p) for p in model.pieces], np.int64)
        self.low = np.array([self.packed(model.pieces[i], 0) for i in self.ids], np.uint64)
        self.high = np.array([self.packed(model.pieces[i], STOP) for i in self.ids], np.uint64)
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.runs: dict[int, bytes] = {0: b""}
        self.apart: dict[int, bool] = {}
        self.recent_keys = np.full(1 << 20, -1, np.int64)
        self.recent = np.zeros(1 << 20, bool)
        self.ends: dict[int, tuple[list[bytes], list[bytes]]] = {}

    @staticmethod
    def packed(piece: bytes, fill: int) -> int:
        return int.from_bytes((piece[:8] + bytes([fill]) * 8)[:8], "big")

    def merged(self, text: str) -> list[bytes]:
        """Merge neighbours by score, the leftmost first among equals."""
        parts: list[bytes | None] = [c.encode() for c in text]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, bytes, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.id_of:
                    heapq.heappush(queue, (-self.model.scores[self.id_of[both]], i, both, j))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, both, j = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces gives these two."""
        for t in (a, b):
            if t not in self.ends:
                p = self.model.pieces[t]
                chars = p.decode()
                self.ends[t] = ([c for k in range(len(chars)) if (c := chars[k:].encode()) in self.id_of], [c for k in range(1, len(chars) + 1) if (c := chars[:k].encode()) in self.id_of])
        id_of = self.id_of
        if not any(x + y in id_of for x in self.ends[a][0] for y in self.ends[b][1]):
            return True
        pieces = self.model.pieces
        return self.merged_short((pieces[a] + pieces[b]).decode()) == [pieces[a].decode(), pieces[b].decode()]

    def merged_short(self, text: str) -> list[str]:
        """The same merges by looking at all neighbours again and again: faster for a few characters."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            ranks = [rank.get(x + y, 0) for x, y in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 0:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def all_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * 65536 + b
        slot = (keys * 0x9E3779B1 >> 12) & (len(self.recent) - 1)
        unseen = np.flatnonzero(self.recent_keys[slot] != keys)
        out = self.recent[slot]
        if len(unseen):
            different, back = np.unique(keys[unseen], return_inverse=True)
            if len(self.apart) > KEPT_PAIRS:
                self.apart.clear()
            found = np.empty(len(different), bool)
            for n, k in enumerate(different.tolist()):
                known = self.apart.get(k)
                if known is None:
                    known = self.apart[k] = self.stays_apart(k >> 16, k & 65535)
                found[n] = known
            out[unseen] = found[back]
            at = (different * 0x9E3779B1 >> 12) & (len(self.recent) - 1)
            self.recent_keys[at], self.recent[at] = different, found
            # two keys of one slot: the last one written counts for both arrays, as both use the same order
        return out

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of every piece, from the suffix array of the characters' starts."""
        at = np.flatnonzero(((data & 0xC0) != 0x80) & (data != STOP))
        padded = np.concatenate([data, np.full(8, STOP, np.uint8)])
        key = np.zeros(len(at), np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | padded[at + j].astype(np.uint64)
        order = np.argsort(key)
        key, suffix = key[order], at[order]
        first, last = np.searchsorted(key, self.low), np.searchsorted(key, self.high, side="right")
        size = self.length[self.ids]
        for i in np.flatnonzero((size > 8) & (last > first)):  # longer than a key: order that range further
            a, b, piece = first[i], last[i], self.model.pieces[self.ids[i]]
            tails = sorted((data[s + 8 : s + len(piece)].tobytes(), s) for s in suffix[a:b].tolist())
            suffix[a:b] = [s for _, s in tails]
            rest = piece[8:]
            low = next((n for n, t in enumerate(tails) if t[0] >= rest), len(tails))
            high = next((n for n, t in enumerate(tails) if t[0] > rest), len(tails))
            # later pieces with the same start order this range anew, so its hits are taken now
            yield_at = suffix[a + low : a + high].copy()
            self._long.append((yield_at, np.full(len(yield_at), self.ids[i])))
        short = (size <= 8) & (last > first)
        counts = (last - first)[short]
        spots = np.repeat(first[short] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        starts, ids = [suffix[spots]], [np.repeat(self.ids[short], counts)]
        for s, t in self._long:
            starts.append(s)
            ids.append(t)
        return np.concatenate(starts), np.concatenate(ids)

    def learn(self, words: list[bytes]) -> None:
        """Encode distinct words (each with the blank before it) and keep their ids."""
        begin = 0
        while begin < len(words):
            end, size = begin, 0
            while end < len(words) and (end == begin or size + len(words[end]) < BATCH_BYTES):
                size += len(words[end]) + 2
                end += 1
            self.learn_batch(words[begin:end])
            begin = end

    def learn_batch(self, words: list[bytes]) -> None:
        data = np.frombuffer(b"".join(b" " + w + b"\xff" for w in words), np.uint8).copy()
        data[data == 0] = NUL
        stops = np.flatnonzero(data == STOP)
        begins = np.concatenate([[0], stops[:-1] + 1])
        self._long: list = []
        start, piece = self.edges(data)
        lead = ((data & 0xC0) != 0x80) & (data != STOP)
        width = np.diff(np.append(np.flatnonzero(lead | (data == STOP)), len(data)))
        char_size = np.zeros(len(data), np.int64)
        char_size[np.flatnonzero(lead | (data == STOP))] = width
        single = np.zeros(len(data), bool)
        single[start[self.length[piece] == char_size[start]]] = True
        odd = np.flatnonzero(lead & ~single)  # characters that no piece covers: their bytes stand for them
        start, piece = np.concatenate([start, odd]), np.concatenate([piece, np.full(len(odd), NO_PIECE)])
        step = np.where(piece == NO_PIECE, char_size[start], self.length[np.minimum(piece, len(self.length) - 1)])
        finish = start + step
        begin_of = np.repeat(begins, stops - begins + 1)
        place = finish - begin_of[start]
        order = np.argsort(place, kind="stable")
        start, piece, finish, place = start[order], piece[order], finish[order], place[order]
        last = np.full(len(data) + 1, -1, np.int64)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
        opening = begin_of[start] == start
        for a, b in zip(bounds[:-1], bounds[1:]):
            s, t = start[a:b], piece[a:b]
            before = last[s]
            fits = opening[a:b] | (before == NO_PIECE) | ((before >= 0) & (t == NO_PIECE))
            ask = np.flatnonzero(~fits & (before >= 0))
            fits[ask] = self.all_apart(before[ask], t[ask])
            last[finish[a:b][fits]] = t[fits]
        chosen = np.zeros(len(data) + 1, bool)
        at, floor = stops.copy(), begins
        while len(at):
            chosen[at] = True
            t = last[at]
            at = at - np.where(t == NO_PIECE, self._back(data, at), self.length[np.minimum(t, len(self.length) - 1)])
            going = at > floor
            at, floor = at[going], floor[going]
        ends = np.flatnonzero(chosen)
        tokens = last[ends]
        if (tokens == NO_PIECE).any():
            sizes = np.where(tokens == NO_PIECE, self._back(data, ends), 1)
            raw = np.where(data == NUL, 0, data)
            where = np.repeat(ends - sizes, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids = np.where(np.repeat(tokens == NO_PIECE, sizes), np.array(self.model.byte_ids)[raw[where]], np.repeat(tokens, sizes))
            ends = np.repeat(ends, sizes)
            tokens = ids
        cuts = np.searchsorted(ends, stops, side="right")
        flat, a = tokens.astype("<u2").tobytes(), 0
        for w, b in zip(words, (2 * cuts).tolist()):
            self.words[w] = flat[a:b]
            a = b

    @staticmethod
    def _back(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bytes of the character before each place."""
        n = np.ones(len(ends), np.int64)
        for _ in range(3):
            n += (data[np.maximum(ends - n, 0)] & 0xC0) == 0x80
        return n

    def run_of(self, n: int) -> bytes:
        """Ids of ``n`` blanks that no word takes."""
        if n not in self.runs:
            if len(self.runs) > 10_000:
                self.runs = {0: b""}
            self.runs[n] = np.array([self.id_of[p] for p in self.merged(" " * n)], "<u2").tobytes()
        return self.runs[n]

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of whole texts; null stays null, the empty text has none."""
        split = [None if t is None else (b" " + t.encode().replace(SPACE.encode(), b" ")).split(b" ")[1:] if t else [] for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.older, self.words = self.words, {}
        unmet = {w for words in split if words for w in words if w and w not in self.words}
        for w in unmet & self.older.keys():
            self.words[w] = self.older[w]
        self.learn([w for w in unmet if w not in self.words])
        blank, out = np.array([self.id_of[b" "]], "<u2").tobytes(), []
        get = self.words.get
        for words in split:
            if words is None:
                out.append(None)
                continue
            if b"" in words:
                parts, blanks = [], 0
                for w in words:
                    blanks += 1
                    if w:
                        ids = get(w)
                        # a blank that the word doesn't take joins those before it
                        free = ids[:2] == blank
                        parts += [self.run_of(blanks - 1 + free), ids[2:] if free else ids]
                        blanks = 0
                parts.append(self.run_of(blanks))
            else:
                parts = map(get, words)
            out.append(np.frombuffer(b"".join(parts), "<u2"))
        return out


def decoded(model: PieceModel, ids: np.ndarray, table: list[bytes] | None = None) -> str:
    """The text of ids: pieces and bytes joined, without the blank that encoding puts in front."""
    table = table or byte_table(model)
    return b"".join([table[i] for i in ids.tolist()]).decode(errors="replace").removeprefix(" ")


def byte_table(model: PieceModel) -> list[bytes]:
    table = list(model.pieces)
    for value, i in enumerate(model.byte_ids):
        table[i] = bytes([value])
    return table


def parts_of(texts: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and number of consecutive rows: at most ``rows`` of them, and ``size`` bytes where they are more than one."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    start = 0
    while start < len(texts):
        fits = int(np.searchsorted(ends, ends[start] + size, side="right")) - 1
        n = max(1, min(fits, start + rows) - start)
        yield start, n
        start += n


def encoder_of(model: PieceModel) -> Encoder:
    """One encoder for each worker process and model, kept between tasks with the words it knows."""
    mark, kept = hash((model.pieces, model.scores, model.byte_ids)), sys.__dict__.setdefault("_piece_encoder", {})
    if mark not in kept:
        kept.clear()
        kept[mark] = Encoder(model)
    return kept[mark]


def encode(docs: DataFrame, model: PieceModel, text: str = "text", rows: int = 1024) -> DataFrame:
    """``docs`` without its text, with ``ids`` and ``n_tokens``, and ``decodes``: whether decoding the ids gives the text back.

    A null text has null ids, 0 tokens and a null ``decodes``; an empty one has no ids.  The character that models
    write for a blank counts as one.  Columns of the three names are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "ids", "n_tokens", "decodes")]
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.scores, model.byte_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel(*shared.value)
        encoder, table = encoder_of(own), byte_table(own)
        for batch in batches:
            for start, n in parts_of(batch.column(0), rows, TEXT_BYTES):
                part = batch.slice(start, n)
                texts = part.column(0).to_pylist()
                ids = encoder.encode(texts)
                back = [None if t is None else decoded(own, i, table) == t.replace(SPACE, " ") for t, i in zip(texts, ids)]
                sizes = [0 if i is None else len(i) for i in ids]
                flat = pa.array(np.concatenate([i for i in ids if i is not None] or [np.zeros(0, "<u2")]).astype(np.int32))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, flat, mask=pa.array([i is None for i in ids]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], lists, pa.array(np.array(sizes, np.int64)), pa.array(back, pa.bool_())],
                    names=[*kept, "ids", "n_tokens", "decodes"],
                )

    schema = docs.select(*kept).withColumn("ids", F.lit(None).cast("array<int>")).withColumn("n_tokens", F.lit(0).cast("long")).withColumn("decodes", F.lit(None).cast("boolean")).schema
    return docs.select(text, *kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: PieceModel, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in place of them; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast((model.pieces, model.scores, model.byte_ids))

    @F.pandas_udf("string")
    def back(column):
        own = PieceModel(*shared.value)
        table = byte_table(own)
        return column.map(lambda x: None if x is None else decoded(own, np.asarray(x, np.int64), table))

    kept = [c for c in encoded.columns if c not in (ids, text)]
    return encoded.select(*kept, back(F.col(ids)).alias(text))


# workers get this module's functions with the task, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
