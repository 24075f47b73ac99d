"""Vector codes, source divergence and packing against plain versions, and odd inputs."""

import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import divergence, packing, registry, vector_codes

WORDS = registry.WORD_MODEL


def codes_by_hand(rows, p):
    """Every part against every entry: ids, codes, errors and entries."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.floor(np.array([v for _, v in rows], float) * p.scale).astype(np.int64).reshape(len(rows), p.parts, -1)
    books = x[: p.entries].transpose(1, 0, 2).copy()
    for step in range(p.rounds + 1):
        apart = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        code = apart.argmin(-1)
        if step < p.rounds:
            for part in range(p.parts):
                for e in set(code[:, part]):
                    mine = x[code[:, part] == e, part]
                    books[part, e] = mine.sum(0) // len(mine)
    return [(i, bytes(c.tolist()), int(a)) for (i, _), c, a in zip(rows, code, apart.min(-1).sum(1))], books


def vector_rows(seed, n, width=8):
    """Clusters, repeated vectors and vectors on a coarse grid, where distances tie."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * 0.2
    x[::3] = np.round(x[::3] * 4) / 4
    x[1::9] = x[0]
    return [(int(i), v) for i, v in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("p", [
    vector_codes.CodeParams(4, 16, 2, 256, 4, 2),
    vector_codes.CodeParams(4, 16, 5, 16, 2, 1),
    vector_codes.CodeParams(2, 8, 3, 256, 8, 1),
    vector_codes.CodeParams(4, 1, 2, 256, 16, 8),
    vector_codes.CodeParams(4, 64, 2, 256, 1, 1),
])
def test_codes_equal_plain_rounds(spark, p):
    rows = vector_rows(p.entries, 600)
    table = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in rows], "vec_id long, embedding array<double>, label int")
    codes, books = vector_codes.compress(table.repartition(5), p)
    wanted, entries = codes_by_hand(rows, p)
    assert sorted((r["id"], bytes(r["code"]), r["error"]) for r in codes.collect()) == sorted(wanted)
    assert (books.values == entries).all()
    near = books.decode(np.array([list(c) for _, c, _ in wanted]))
    whole = np.floor(np.array([v for _, v in sorted(rows, key=lambda r: r[0])]) * p.scale)
    assert (((near - whole) ** 2).sum(1) == [e for _, _, e in wanted]).all()


def test_bounds_save_comparisons():
    """Clustered parts with entries that hardly move: most keep their entry by bounds alone."""
    rng = np.random.default_rng(5)
    book = rng.integers(-1000, 1000, (64, 4))
    x = book[rng.integers(0, 64, 5000)] + rng.integers(-20, 20, (5000, 4))
    scale = vector_codes.Scale(1100, 4)
    lists = vector_codes.Lists.of(scale.to_all(x, book), 8, scale)
    after = book + rng.integers(-2, 3, book.shape)
    moved = np.ceil(np.sqrt(vector_codes.squared(after, book)) / scale.unit).astype(np.int64) + 1
    depth = vector_codes.reassign(x, after, moved, lists, scale)
    assert (lists.near[:, 0] == scale.to_all(x, after).argmin(1)).all()
    assert (depth == 0).mean() > 0.8 and (depth == vector_codes.BEYOND).mean() < 0.05
    far = np.sqrt(np.take_along_axis(scale.to_all(x, after), lists.near[:, 1:], 1)) / scale.unit
    assert (lists.lower <= far + 1e-6).all() and (np.diff(lists.lower, axis=1) >= 0).all()


def test_list_length_follows_the_depths():
    p, depths = vector_codes.CodeParams(), np.zeros(256, np.int64)
    depths[0] = 1000
    assert vector_codes.next_nearest(depths, 16, p) == 8
    depths[14] = 900
    assert vector_codes.next_nearest(depths, 16, p) == 14
    depths[14], depths[255] = 0, 900
    assert vector_codes.next_nearest(depths, 16, p) == 8


def test_codes_of_odd_rows(spark):
    p = vector_codes.CodeParams(2, 4, 2, 256, 2, 1)
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.5 * i, -1.0, 0.25, i / 7.0], i % 2 or None) for i in range(9)] + [(3, [0.0, 0.0, 0.0, 0.0], None), (None, [9.0, 9.0, 9.0, 9.0], 1), (4, [2.0, -1.0, 0.25, 4 / 7.0], None)]
    bad = [(100, None, 1), (101, [1.0, None, 1.0, 1.0], 1), (102, [nan, 1.0, 1.0, 1.0], 1), (103, [1.0, -inf, 1.0, 1.0], 1), (104, [1.0], 1), (-5, [], 1)]
    schema = "vec_id long, embedding array<double>, label int, id long, x string, code string, error long, near int, of int, label_error int"
    table = spark.createDataFrame([(*r, 1, "x", "c", 2, 3, 4, 5) for r in good + bad], schema)
    codes, _ = vector_codes.compress(table, p)
    got = vector_codes.with_label_errors(codes).collect()
    wanted, _ = codes_by_hand([(i, np.array(v)) for i, v, _ in good], p)
    order = lambda rows: sorted(rows, key=str)
    assert order([(r["id"], bytes(r["code"]), r["error"]) for r in got]) == order(wanted)
    sums = Counter()
    for r in got:
        sums[r["label"]] += r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in got) and None in sums
    codes, books = vector_codes.compress(table.limit(0), p)
    assert codes.count() == 0 and books.values.size == 0 and vector_codes.with_label_errors(codes).count() == 0
    uneven = spark.createDataFrame([(1, [0.5, 0.25, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(uneven, p)[0].first()["error"] == 0
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30, 1.0], 1)], "vec_id long, embedding array<double>, label int"), p)


def audit_by_hand(rows, p):
    upper = {c: c + 32 for c in range(65, 91)}
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = "".join(c if c.isascii() and c.isalpha() or ord(c) >= 128 else " " for c in (text or "").translate(upper)).split(" ")
        words = [w for w in words if w]
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= p.min_docs]
        every = sum((c for (g, _), c in groups.items() if g == lang), Counter())

        def shares(count):
            total = sum(count[t] for t in kept) + p.smoothing * len(kept)
            return {t: 1 + p.scale * (count[t] + p.smoothing) // total for t in kept}

        q = shares(every)
        mine = {s: shares(c) for (g, s), c in groups.items() if g == lang}
        for s, a in mine.items():
            pairs = [(-sum((a[t] - b[t]) ** 2 // (a[t] + b[t]) for t in kept), o.encode()) for o, b in mine.items() if o != s]
            terms = [(-((a[t] - q[t]) ** 2 // (a[t] + q[t])), t.encode()) for t in kept if groups[lang, s][t] and a[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[: p.top_terms])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


def text_rows(seed, n=400, sources=9):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "ÄB", "äb", "x1y", "中文", "a-b", "ﬁn", "É"] + [f"w{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(120)]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(None, "en", "src0"), ("", None, None), (None, None, "s"), ("lonely words here", "xx", "only"), ("", "yy", "a"), ("?", "yy", "b")]
    for _ in range(n):
        source = f"src{rng.choice([0, 0, 0, *range(sources)])}"
        rows.append((" ".join(rng.choices(vocabulary, weight, k=rng.randrange(0, 60))), rng.choice(["en", "en", "fr", None]), source))
    return rows


@pytest.mark.parametrize("p", [divergence.DivergenceParams(), divergence.DivergenceParams(3, 4, 2, 10**9, 16, 2, 5, 7, 50), divergence.DivergenceParams(2, 3, block_terms=1, block_sources=4)])
def test_audit_equals_the_definition(spark, p):
    rows = text_rows(p.min_docs)
    table = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    got = [tuple(r) for r in divergence.audit(table, p).collect()]
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(rows, p)


def test_audit_of_odd_rows(spark, odd, none):
    p = divergence.DivergenceParams(min_docs=1)
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()] + [("a b", "en", "other")]
    more = odd.select("text", "lang", "source").union(spark.createDataFrame(rows[-1:], "text string, lang string, source string"))
    clash = more.withColumns({c: F.lit(1) for c in ("term", "n", "docs", "item", "value", "rank", "part", "terms")})
    assert {tuple(r) for r in divergence.audit(clash, p).collect()} == audit_by_hand(rows, p)
    assert divergence.audit(none).count() == 0


def first_fit_by_hand(sizes, room):
    free, bins = [], []
    for size in sizes:
        place = next((i for i, f in enumerate(free) if f >= size), len(free))
        if place == len(free):
            free.append(room)
        free[place] -= size
        bins.append(place)
    return bins


def test_first_fit_equals_a_scan():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 17, 64, 300):
        sizes = sorted((rng.choice([1, 50, 99, 100, rng.randint(1, 100)]) for _ in range(n)), reverse=True)
        assert packing.first_fit(sizes, 100) == first_fit_by_hand(sizes, 100)


@pytest.mark.parametrize("sizes", [[], [1], [2047], [1500] * 40, [1025] * 3, sorted(random.Random(1).choices(range(1, 2048), k=500), reverse=True)])
def test_sequences_hold_everything_without_padding(sizes):
    made = packing.pack_sizes(sizes, 2048)
    loads = [sum(n for _, _, n in s) for s in made]
    assert sum(loads) == sum(sizes) and all(load & load - 1 == 0 and load <= 2048 for load in loads)
    assert sum(load < 2048 for load in loads) <= 11
    parts = defaultdict(list)
    for s in made:
        for item, start, n in s:
            parts[item].append((start, n))
    for item, size in enumerate(sizes):
        at = 0
        for start, n in sorted(parts[item]):
            assert start == at and n > 0
            at += n
        assert at == size
    fitted = packing.first_fit(sizes, 2048)
    opened = sum(sum(s for s, b in zip(sizes, fitted) if b == place) < 2048 for place in set(fitted))
    assert sum(map(len, made)) - len(sizes) <= opened + 11


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), packing.WordIds(WORDS, 50)
    rng = random.Random(6)
    bits = ["a", "Don't", "é", "é", " ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "'s", "１", "中", "😀", "<|endoftext|>", "İ", "Σ", "\x00", "ﬁ", "x" * 300, "<|", "#1", "Zoë!'s", "÷", "ªb", "12.5%", "--'re"]
    texts = ["", " ", *("".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000))]
    for text in texts:
        assert np.frombuffer(own.of([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def packed_fully(docs, placed, p):
    """Round trip: the pieces of every document in order are its ids, and sequences are laid out without gaps."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    wanted = Counter((r["doc_id"], tuple([*library.encode(r["text"] or "", add_special_tokens=False).ids, p.end_id])) for r in docs.select("doc_id", "text").collect())
    rows = placed.collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= p.length and at & at - 1 == 0
    whole = Counter()
    for doc, count in wanted.items():
        whole[doc[0]] += count
    for (doc, ids), count in wanted.items():
        if whole[doc] == 1:
            assert [x for _, part, _ in sorted(pieces[doc]) for x in part] == list(ids)
            assert {n for _, _, n in pieces[doc]} == {len(ids)}
    for doc in whole:
        assert sum(len(part) for _, part, _ in pieces[doc]) == sum(len(ids) * n for (d, ids), n in wanted.items() if d == doc)
    return sequences


@pytest.mark.parametrize("p", [packing.PackParams(), packing.PackParams(length=64, group_size=20, kept_words=30)])
def test_packing_round_trip(documents, p):
    placed = packing.pack(documents.repartition(6), WORDS, p)
    sequences = packed_fully(documents, placed, p)
    short = sum(sum(n for _, n in s) < p.length for s in sequences.values())
    groups = -(-documents.count() // p.group_size)
    assert short <= groups * p.length.bit_length()


def test_packing_of_odd_rows(odd, none):
    p = packing.PackParams(group_size=3)
    clash = odd.withColumns({c: F.lit(1) for c in ("row", "start", "length", "ids", "group", "key", "sequence_id", "offset", "doc_tokens")})
    placed = packing.pack(clash, WORDS, p)
    packed_fully(odd, placed, p)
    empty = placed.where("doc_id in (1, 2, 3)").select("length", "doc_tokens").collect()
    assert [tuple(r) for r in empty] == [(1, 1)] * 3
    assert packing.pack(none, WORDS, p).count() == 0


def test_one_text_without_blanks(spark):
    p = replace(packing.PackParams(), length=256)
    docs = spark.createDataFrame([(1, "ab中" * 20000)], "doc_id long, text string")
    packed_fully(docs, packing.pack(docs, WORDS, p), p)


@pytest.mark.parametrize("name, columns", [
    ("op11_vector_codes", {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}),
    ("op12_source_divergence", {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}),
    ("op13_packing", {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}),
])
def test_queries_return_their_columns(spark, sf, name, columns):
    found = registry.QUERIES[name](spark, sf)
    assert dict(found.dtypes) == columns and found.count() > 0
