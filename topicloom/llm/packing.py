"""Packing: documents as token ids, cut and packed into training sequences of a fixed length.

A document that is longer than a sequence gives whole sequences of its own; what is left of every document
is shorter than one.  These rests are dealt at random into groups of bounded size, and each group is packed by
first-fit decreasing: the longest rest first, each into the first sequence with room.  A tournament tree over
the sequences' free room finds that sequence in logarithmic time.  What first-fit leaves free is then filled by
cutting: the emptiest sequences of the group give their ids to the gaps of the fullest, and the one sequence
that stays open is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import materialise

ID_BYTES = 4  # of an id as written: unsigned, little-endian
PART_BITS = 37  # a sequence's number: the task or group above these bits, its count below
OUT_BYTES = 32 << 20
TEXT_BYTES = 4 << 20  # of texts that are cut together


@dataclass(frozen=True)
class PackParams:
    """``end_id`` closes every document.  ``group_size`` is the mean number of rests packed together: it bounds
    what a task holds (each rest has fewer than ``length`` ids)."""

    length: int = 2048
    end_id: int = 1
    group_size: int = 4096
    seed: int = 13
    kept_words: int = 400_000


# How a tokenizer of this kind prepares a text and where it cuts it.
NORMAL = ["NFC", "Replace", "Lowercase"]
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
PARTS_AT_ONCE = 2000

# Bytes of the texts whose cuts are found by their bytes: ASCII and the letters of Latin-1, which normal form and
# lower case leave among themselves.  A letter beyond ASCII is LEAD and a byte after it.
BLANK, LETTER, DIGIT, SIGN, AFTER, ODD = range(6)
LEAD = 0xC3
KIND = np.full(256, ODD, np.uint8)
KIND[0x21:0x7F], KIND[0x80:0xC0], KIND[[9, 10, 11, 12, 13, 32]] = SIGN, AFTER, BLANK
KIND[ord("0") : ord("9") + 1], KIND[ord("A") : ord("Z") + 1], KIND[ord("a") : ord("z") + 1], KIND[LEAD] = DIGIT, LETTER, LETTER, LETTER
BLANKS = re.compile(rb"[\x20\x09-\x0D]")


def plain(data: np.ndarray) -> np.ndarray:
    """Where bytes are none of a plain text: odd ones, half letters, the signs of times and division."""
    kind = KIND[data]
    after_lead = np.r_[False, data[:-1] == LEAD]
    return (kind == ODD) | ((kind == AFTER) != after_lead) | after_lead & ((data == 0x97) | (data == 0xB7))


def cut_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data`` in lower case, and where its parts start: runs of letters, single digits, runs of signs, and
    the endings that an apostrophe opens.  Blanks belong to no part."""
    kind = KIND[data]
    after = kind == AFTER
    low = data + 32 * (((data >= 0x41) & (data <= 0x5A)) | after & (data <= 0x9E)).astype(np.uint8)
    kind[after] = LETTER
    start = (np.r_[np.uint8(BLANK), kind[:-1]] != kind) & (kind != BLANK) | (kind == DIGIT)
    at = np.flatnonzero((low == ord("'")) & start)
    if len(at):
        ahead = np.concatenate([low, np.zeros(3, np.uint8)])
        one, two = ahead[at + 1], ahead[at + 2]
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
        size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 2
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        rest = at + 1 + size
        rest = rest[rest < len(low)]
        start[rest[kind[rest] == LETTER]] = True
    return low, start


class WordIds:
    """Ids of whole texts by a tokenizer that never joins what ASCII blanks part.

    Where the tokenizer cuts texts by ``CUTS``, plain texts are cut by their bytes, and every distinct part is
    encoded once by the library, many in one text.  Other texts go to it word by word between blanks, each
    distinct word once.  When ``kept_words`` parts are remembered, all are forgotten.  Sent as a
    broadcast value, an object serves all tasks of its worker: what is remembered stays behind when
    it is pickled.
    """

    def __init__(self, path: str, kept_words: int):
        self.__setstate__((path, kept_words))

    def __getstate__(self) -> tuple[str, int]:
        return self.path, self.kept_words

    def __setstate__(self, state: tuple[str, int]) -> None:
        self.path, self.kept_words = state
        self.tokenizer, self.ends, self.words, self.parts = None, None, {}, {}

    def open(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        made = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        cuts = [c.get("pattern", {}).get("Regex") for c in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if normal == NORMAL and cuts[:1] == [CUTS] and made["model"].get("end_of_word_suffix") == END:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(END)]] = True

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text; a very long one goes in pieces between blanks."""
        if self.tokenizer is None:
            self.open()
        pieces, owner = [], []
        for i, text in enumerate(texts):
            start = 0
            while len(text) - start > TEXT_BYTES:
                blank = BLANKS.search(text, start + TEXT_BYTES)
                if blank is None:
                    break
                pieces.append(text[start : blank.start()])
                owner.append(i)
                start = blank.end()
            pieces.append(text[start:] if start else text)
            owner.append(i)
        coded = self.coded(pieces)
        if len(coded) == len(texts):
            return coded
        out = [b""] * len(texts)
        for i, ids in zip(owner, coded):
            out[i] += ids
        return out

    def coded(self, texts: list[bytes]) -> list[bytes]:
        out, size, begin = [b""] * len(texts), 0, 0
        easy = [i for i, text in enumerate(texts) if self.ends is not None and b"<|" not in text]
        for place, i in enumerate(easy):
            size += len(texts[i])
            if size > TEXT_BYTES or place == len(easy) - 1:
                self.code_plain(texts, easy[begin : place + 1], out)
                size, begin = 0, place + 1
        for i in sorted(set(range(len(texts))) - set(easy)):
            out[i] = self.code_words(texts[i])
        return out

    def code_words(self, text: bytes) -> bytes:
        if len(self.words) > self.kept_words:
            self.words = {}
        words = text.split()
        new = list(set(words) - self.words.keys())
        for word, e in zip(new, self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)):
            self.words[word] = np.array(e.ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, words))

    def code_plain(self, texts: list[bytes], chosen: list[int], out: list[bytes]) -> None:
        """Fill in the ids of the chosen texts; those that are not plain go word by word."""
        data = np.frombuffer(b"\n".join([texts[i] for i in chosen]), np.uint8)
        stops = np.cumsum([len(texts[i]) + 1 for i in chosen])
        odd = np.unique(np.searchsorted(stops, np.flatnonzero(plain(data)), side="right")).tolist()
        if odd:
            for n in odd:
                out[chosen[n]] = self.code_words(texts[chosen[n]])
            rest = sorted(set(range(len(chosen))) - set(odd))
            if rest:
                self.code_plain(texts, [chosen[n] for n in rest], out)
            return
        low, start = cut_bytes(data)
        filled = KIND[data] != BLANK
        begins = np.flatnonzero(start)
        offsets = np.append((np.cumsum(filled) - filled)[begins], filled.sum()).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(low[filled])]).dictionary_encode()
        known = self.known(parts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // ID_BYTES
        ids, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        part = parts.indices.to_numpy()
        many = sizes[part]
        ends = np.cumsum(many)
        ids = ids[np.repeat(first[part] - (ends - many), many) + np.arange(many.sum())].tobytes()
        bounds = (np.concatenate([[0], ends])[np.searchsorted(begins, np.concatenate([[0], stops]))] * ID_BYTES).tolist()
        for i, a, b in zip(chosen, bounds[:-1], bounds[1:]):
            out[i] = ids[a:b]

    def known(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts.  Every part ends with an id that ends a word, so the ids of many in one text can
        be told apart."""
        if len(self.parts) + len(parts) > self.kept_words:
            self.parts = {}
        kept = self.parts
        new = [p for p in parts if p not in kept]
        for at in range(0, len(new), PARTS_AT_ONCE):
            some = new[at : at + PARTS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * ID_BYTES
            if len(stops) != len(some):
                raise ValueError("the tokenizer does not end every word with an id of its own")
            flat, start = ids.tobytes(), 0
            for part, stop in zip(some, stops.tolist()):
                kept[part] = flat[start:stop]
                start = stop
        return [kept[p] for p in parts]


CHUNKS = "row bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


def cut_texts(sent: Broadcast, p: PackParams):
    """The task that turns ``(key, text)`` batches into whole sequences and one rest for each document.

    ``row`` numbers the pieces of a task; with the task's number it is unique in the written table.
    """
    whole, end = p.length * ID_BYTES, np.array([p.end_id], "<u4").tobytes()

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, made = sent.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            keys, out, held = [], [], 0
            ends = np.cumsum([len(t) for t in texts]) // TEXT_BYTES
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                for i, ids in zip(some.tolist(), words.of([texts[i] for i in some])):
                    ids += end
                    for start in range(0, len(ids), whole):
                        piece = ids[start : start + whole]
                        keys.append(i)
                        out.append((part << PART_BITS | made, start // ID_BYTES, len(piece) // ID_BYTES, len(ids) // ID_BYTES, piece))
                        made, held = made + 1, held + len(piece)
                        if held > OUT_BYTES:
                            yield piece_batch(batch.column(0), keys, out)
                            keys, out, held = [], [], 0
            if keys:
                yield piece_batch(batch.column(0), keys, out)

    return job


def piece_batch(key: pa.Array, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
    columns = [key.take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in list(zip(*out))[:4]), pa.array([o[4] for o in out], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["key", "row", "start", "length", "doc_tokens", "ids"])


def first_fit(sizes: list[int], room: int) -> list[int]:
    """For each size in turn the first bin with room for it; no size is above ``room``.

    The leaves of the tree are the bins' free room, every inner node is the larger of its two children.
    """
    leaves = 1 << max(len(sizes) - 1, 0).bit_length()
    free, bins = [room] * (2 * leaves), []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins.append(node - leaves)
        free[node] -= size
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
    return bins


def pack_sizes(sizes: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(item, start, length)`` for sizes in falling order.

    Every sequence is full or a power of two long.  First-fit places items whole; only items of sequences
    that it left open are cut, at most one for each open sequence and each power of two.
    """
    made: list[list[tuple[int, int, int]]] = []
    for item, place in enumerate(first_fit(sizes, room)):
        if place == len(made):
            made.append([])
        made[place].append((item, 0, sizes[item]))
    loads = [sum(n for _, _, n in s) for s in made]
    done = [s for s, load in zip(made, loads) if load == room]
    left = [made[i] for i in sorted((i for i, load in enumerate(loads) if load < room), key=lambda i: (-loads[i], i))]
    while len(left) > 1:
        target, gap = left[0], room - sum(n for _, _, n in left[0])
        while gap and len(left) > 1:
            item, start, n = left[-1].pop()
            taken = min(n, gap)
            target.append((item, start, taken))
            gap -= taken
            if taken < n:
                left[-1].append((item, start + taken, n - taken))
            elif not left[-1]:
                left.pop()
        if not gap:
            done.append(left.pop(0))
    for rest in left:
        done.extend(powers_of_two(rest))
    return done


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The same ids as sequences whose lengths are falling powers of two."""
    load, queue = sum(n for _, _, n in pieces), list(reversed(pieces))
    while load:
        gap, part = 1 << load.bit_length() - 1, []
        load -= gap
        while gap:
            item, start, n = queue.pop()
            part.append((item, start, min(n, gap)))
            if n > gap:
                queue.append((item, start + gap, n - gap))
            gap -= part[-1][2]
        yield part


def pack_group(p: PackParams):
    """The function of one group of rests: its pieces, placed."""

    def job(group: pa.Table) -> pa.Table:
        lengths, rows = group.column("length").to_numpy(), group.column("row").to_numpy()
        order = np.lexsort((rows, -lengths))
        number = group.column("group")[0].as_py()
        sequences = pack_sizes(lengths[order].tolist(), p.length)
        flat = [(order[item], s, n, number << PART_BITS | count) for count, sequence in enumerate(sequences) for item, s, n in sequence]
        item, shift, length, sequence = (np.array(c, np.int64) for c in zip(*flat))
        ends = np.cumsum(length)
        first = np.r_[True, sequence[1:] != sequence[:-1]]
        offset = ends - length - np.repeat((ends - length)[first], np.diff(np.r_[np.flatnonzero(first), len(first)]))
        taken = group.take(pa.array(item))
        ids = [v[s * ID_BYTES : (s + n) * ID_BYTES] for v, s, n in zip(taken.column("ids").to_pylist(), shift, length)]
        # even numbers: sequences of groups; odd ones: whole sequences of one document
        values = [taken.column("key"), taken.column("start").to_numpy() + shift, length, taken.column("doc_tokens"), sequence * 2, offset, pa.array(ids, pa.binary())]
        return pa.table(dict(zip(["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"], values)))

    return job


def pack(docs: DataFrame, tokenizer: str, p: PackParams = PackParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, start, length, doc_tokens, sequence_id, offset, ids)``: every piece of every document, placed.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's; ``ids`` are the piece's
    ids as unsigned little-endian 32-bit numbers, ``doc_tokens`` counts all ids of the document with
    ``end_id``.  A null or empty text is ``end_id`` alone.  Every row is a document of its own, also with a
    repeated or null key.  An empty table gives no rows; other columns are ignored.  Ids of a text are those
    of the tokenizer's whole text; the tokenizer must not join what blanks part.

    Deterministic for a written table of the same splits: the pieces are numbered by task and place, which
    also deals them into groups, so that no key can make a group large.
    """
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(WordIds(tokenizer, p.kept_words))
    cut = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cut_texts(sent, p), f"key {kind}, {CHUNKS}")
    chunks = materialise(cut, "chunks")
    rests = chunks.where(F.col("length") < p.length)
    groups = max(1, -(-rests.count() // p.group_size))
    dealt = rests.withColumn("group", F.pmod(F.xxhash64("row", F.lit(p.seed)), F.lit(groups)))
    out = f"key {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    packed = dealt.groupBy("group").applyInArrow(pack_group(p), out)
    whole = chunks.where(F.col("length") == p.length).select(
        "key", "start", "length", "doc_tokens", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids"
    )
    return packed.union(whole).withColumnRenamed("key", key)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
