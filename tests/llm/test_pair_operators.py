"""Duplicates, passages, lines, neighbours, mixing: against brute force, and odd inputs."""

import os
import random
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from topicloom.llm import line_dedup, mixing, near_dup, neighbours, passages
from topicloom.llm.graph import components
from topicloom.runtime import scratch_root


def near_copies(seed, n=160, words=120):
    """Groups of texts with a few changed words, some exact copies."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            w = rng.choice(texts[-30:]).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(f"q{rng.randrange(10**6)}" for _ in range(words)))
    return texts


def grouped(texts, percent=85):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    texts = list(enumerate(near_copies(3) + ["one two", "One TWO", "", None, "É é e f g h"]))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    small = near_dup.NearDupParams(block=16, chunk=8)  # so that groups span several blocks
    for p in (near_dup.NearDupParams(), small):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, p).collect()}
        assert got == grouped(texts)


def test_nodes_just_beyond_the_limit_are_compared(spark):
    """2,850 of 3,353 shingles shared is less than 85 %, yet so near that both nodes fall into ring 0."""
    around = spark.createDataFrame([(0, i, 2850, 3000, 3203) for i in (1, 2)] + [(0, 3, 2900, 3000, 3203)], near_dup.SHARED)
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "u v w x y z")], "node long, text string")
    assert {tuple(sorted(r)) for r in near_dup.ring_links(around, texts, near_dup.NearDupParams()).collect()} == {(1, 2)}


def test_near_duplicates_odd_rows(odd, none):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[1]["n_shingles"] == 0 and by[1]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_dup.near_duplicates(none).count() == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    b = np.concatenate([a[:3600], np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))])
    x, y = near_dup.signatures([a, b], 1024)
    assert abs((x == y).mean() - 3600 / 4400) < 0.04


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: v for x, v in label.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_passages_planted(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    exact, fuzzy, short = fresh(60), fresh(90), fresh(25)
    changed = [w if i % 19 else "zz" for i, w in enumerate(fuzzy)]
    texts = [fresh(80) + exact + fresh(30), fresh(10) + exact, fresh(40) + fuzzy + fresh(40), fresh(5) + changed, fresh(70) + short, short + fresh(60), fresh(200)]
    texts.append(texts[6])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = passages.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(1, 0), (3, 2), (7, 6)}
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["start"], by[1]["end"], by[1]["other_start"], by[1]["other_end"]) == (10, 70, 80, 140)
    assert by[3]["start"] <= 6 and by[3]["matched"] >= 80 and by[7]["exact_copy"]


def test_passages_between_other_words(spark):
    """Exact passages stay whatever lies between them, and where their k-mers repeat."""
    rng = random.Random(10)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    x, y = fresh(60), fresh(60)
    texts = [x + fresh(100) + y, x + fresh(100) + y]
    stray, z = fresh(8), fresh(60)
    texts += [stray + fresh(70) + z, stray + fresh(62) + z]
    twice = fresh(60)
    texts += [fresh(9) + twice, twice[20:32] + fresh(30) + twice + fresh(30) + twice]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        got[r["doc_id"], r["other_id"]].add((r["start"], r["end"], r["other_start"], r["other_end"]))
    assert got[1, 0] == {(0, 60, 0, 60), (160, 220, 160, 220)}
    assert got[3, 2] == {(70, 130, 78, 138)}
    assert got[5, 4] == {(42, 102, 9, 69), (132, 192, 9, 69)}


def test_passages_whose_parts_lie_in_earlier_documents(spark):
    """Every seed, and every span of 40 words, is first in a document without the passage."""
    rng = random.Random(11)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    whole, longer = fresh(60), fresh(60)
    texts = [fresh(60) + whole[i : i + 24] for i in range(0, 37, 4)] + [fresh(60) + longer[i : i + 44] for i in range(0, 17, 4)]
    texts += [fresh(5) + x + fresh(7) for x in (whole, longer) for _ in range(2)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["other_id"], r["start"], r["end"]) for r in passages.repeated_passages(docs).collect()}
    n = len(texts) - 4
    assert got == {(n + 1, n, 5, 65), (n + 3, n + 2, 5, 65)}


def test_passages_leave_no_superseded_tables(spark):
    """Of the scratch tables only those that the result still reads stay."""
    rng = random.Random(12)
    shared = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    docs = spark.createDataFrame([(i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(60)] + shared)) for i in range(4)], "doc_id long, text string")
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    found = passages.repeated_passages(docs)
    assert sorted((x[:-33] for x in set(os.listdir(root)) - before)) == ["pairs", "seed-texts", "signed"]
    assert sorted((r.doc_id, r.other_id, r.matched) for r in found.collect()) == [(i, 0, 80) for i in (1, 2, 3)]


def test_passages_with_many_changes(spark):
    """Recall at several distances of changed words; passages of 100 words in documents of 180."""
    rng = random.Random(1)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    texts, step_of = [], {}
    for step in (5, 6, 8, 10, 15):
        for _ in range(20):
            x = fresh(100)
            y = [w if (i + 1) % step else f"z{rng.randrange(10**7)}" for i, w in enumerate(x)]
            step_of[len(texts) + 1, len(texts)] = step
            texts += [fresh(40) + x + fresh(40), fresh(20) + y + fresh(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(docs).collect()}
    assert got <= set(step_of)
    hits = defaultdict(int)
    for pair in got:
        hits[step_of[pair]] += 1
    assert min(hits[s] for s in (8, 10, 15)) >= 19 and min(hits[5], hits[6]) >= 16


def test_common_words_of_long_gaps():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.delete(a, np.arange(0, 2000, 10))
    assert passages.common_words(a, b) == 1800 and passages.common_words(a[:3], a[5:9]) == 0
    for _ in range(20):
        x, y = rng.integers(0, 5, 30).astype(np.uint64), rng.integers(0, 5, 25).astype(np.uint64)
        row = [0] * 26
        for w in x:
            new = [0]
            for c, v in enumerate(y):
                new.append(row[c] + 1 if w == v else max(row[c + 1], new[-1]))
            row = new
        assert passages.common_words(x, y) == row[-1]


def test_pairs_are_compared_without_a_step_for_each_word():
    """Calls made for a pair of long texts are about as many as for a pair of short ones."""

    def calls(n: int) -> int:
        shared = [f"s{i}" for i in range(80)]
        texts = [" ".join([f"{x}{i}" for i in range(n)] + shared) for x in "ab"]
        plain = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(texts)], ["node", "text"])
        packed = next(iter(passages.squeezed(iter([plain])))).column(1)
        rows = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([0, 0]), pa.array([0, 1]), packed], ["first", "chunk", "node", "text"])
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
        try:
            found = [x for batch in passages.chain_pairs(passages.PassageParams())(iter([rows])) for x in batch.to_pylist()]
        finally:
            sys.setprofile(None)
        assert [(x["doc_id"], x["other_id"], x["start"], x["end"], x["matched"]) for x in found] == [(1, 0, n, n + 80, 80)]
        return len(seen)

    assert calls(20000) < 2 * calls(1000)


def test_compared_words_are_told_apart():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"aAbB\xc3\xa9\x00\xff") for _ in range(rng.randrange(1, 5))) for _ in range(3000)] + [b"x" * 70000, b"x" * 69999]
    text = b"\n ".join(words) + b"\t"
    numbers = passages.compared_words(text).tolist()
    number_of = dict(zip(text.lower().split(), numbers))
    assert [number_of[w] for w in text.lower().split()] == numbers
    assert len(set(numbers)) == len(number_of)
    assert not len(passages.compared_words(b"")) and not len(passages.compared_words(b" \n"))


def test_runs_by_brute_force():
    """Without repeats, every maximal run of shared k-mers; with many, runs that can't be grown and that hold each run of min_words."""
    rng, p = np.random.default_rng(9), passages.PassageParams(near=2)
    for letters, n in ((40, 120), (3, 150), (2, 260)):
        a, b = (rng.integers(0, letters, n).astype(np.uint64) for _ in range(2))
        b[20:90] = a[5:75]
        runs = passages.runs_of(a, passages.Held(b, p), p)
        every = set()
        for i in range(n):
            for j in range(n):
                if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                    size = next((m for m in range(min(n - i, n - j)) if a[i + m] != b[j + m]), min(n - i, n - j))
                    every |= {(i, j, size)} if size >= p.k else set()
        assert set(runs) <= every and any(i <= 5 and i + m >= 75 for i, _, m in runs)
        if letters == 40:
            assert set(runs) == every


def test_passages_odd_rows(odd, none):
    rows = passages.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(7, 6)}
    assert passages.repeated_passages(none).count() == 0


def test_best_chain_by_brute_force():
    """The Fenwick tree finds the best score that trying all earlier runs finds."""
    rng, p = random.Random(6), passages.PassageParams()
    for _ in range(30):
        runs = sorted({(rng.randrange(200), rng.randrange(200), rng.randrange(1, 12)) for _ in range(25)})
        score = []
        for i, j, n in runs:
            earlier = [s - p.gap_cost * (i - a - m + j - b - m) for (a, b, m), s in zip(runs, score) if a + m <= i and b + m <= j]
            score.append(n + max([0, *earlier]))
        chain = passages.chains(runs, p)[0]
        cost = sum(p.gap_cost * (x - a - m + y - b - m) for (a, b, m), (x, y, _) in zip(chain, chain[1:]))
        assert abs(sum(m for _, _, m in chain) - cost - max(score)) < 1e-9


def test_edit_distance(spark):
    rng, rows = random.Random(1), []
    for _ in range(600):
        a = [rng.choice("abcé") for _ in range(rng.randrange(50))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            b[rng.randrange(len(b) + 1) : rng.randrange(len(b) + 1)] = [rng.choice("abcé")] if rng.random() < 0.6 else []
        rows.append(("".join(a), "".join(b)))
    pairs = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 4):
        got = line_dedup.edit_distance(pairs, "a", "b", k).withColumn("want", F.least(F.levenshtein("a", "b"), F.lit(k + 1)))
        assert got.where("distance <> want").count() == 0


def lines_by_hand(texts, edits=2, least=20):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    first, out = {}, {}
    for i, t in texts:
        kept = []
        for line in t.split("\n"):
            if len(line) >= least and line.strip():
                near = line in first or any(abs(len(o) - len(line)) <= edits and distance(o, line) <= edits for o in first)
                first.setdefault(line, i)
                if near:
                    continue
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark):
    rng, pool, texts = random.Random(8), [], []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            if pool and rng.random() < 0.5:
                x = list(rng.choice(pool))
                for _ in range(rng.choice([0, 1, 2, 3, 5])):
                    x[rng.randrange(len(x))] = rng.choice(["", "y", "zz"])
                lines.append("".join(x))
            else:
                lines.append("".join(rng.choice("abcdefgh ") for _ in range(rng.choice([8, 20, 21, 22, 40]))))
            pool.append(lines[-1] or "empty")
        texts.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == lines_by_hand(texts)


def test_short_lines_that_repeat(spark):
    """Exact repeats go at every length; short lines within two edits are different lines."""
    texts = [(1, "Menu\nHome\n\nyes\nMenu"), (2, "Menu\nHose\n\nno\nyes"), (3, "--\n \nno\n--\nMENU")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs, line_dedup.EVERY_LINE).collect()}
    assert got == {1: ("Menu\nHome\n\nyes", 1), 2: ("Hose\n\nno", 2), 3: ("--\n \nMENU", 2)}


def test_lines_of_an_id_with_several_texts(spark):
    """Every distinct line stays once, whichever of the texts holds it; equal rows lose the same lines."""
    rows = [(1, "X one\nY two"), (1, "Z three\nX one"), (1, None), (2, "Y two\nW four\nW four"), (2, "Y two\nW four\nW four")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), line_dedup.EVERY_LINE).collect()
    found = sorted((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in got)
    assert found == [(1, "", 0, 0), (1, "X one\nY two", 2, 0), (1, "Z three", 2, 1), (2, "W four", 3, 2), (2, "W four", 3, 2)]


def test_lines_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = got.collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and by[1]["text"] is None and by[1]["n_lines"] == 0 and by[2]["text"] == ""
    assert by[7]["text"] == "" and by[6]["n_dropped"] == 0 and by[5]["n_dropped"] == 0 and by[None]["n_dropped"] == 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32) * rng.uniform(0.7, 1.3, (3000, 1)).astype(np.float32)
    x[10:40] = x[9]  # equal vectors: ties by id
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 24), (5060, [float("nan")] * 24), (5080, [1.0] * 23 + [float("inf")]), (5100, [1.0] * 23 + [None]), (None, [1.0] * 24)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(vectors, lambda i: i % 20 == 0, neighbours.NeighbourParams(rows_per_block=700, queries_per_block=40)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y, hits = x.astype(np.float64), 0
    for q in range(0, 3000, 20):
        score = y @ y[q]
        best = [i for i in np.lexsort((np.arange(3000), -np.round(score, 12))) if i != q][:20]
        hits += len({i for i, _ in got[q]} & set(best))
        assert len(got[q]) == 20 and all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(got[q], got[q][1:]))
    assert set(got) == set(range(0, 3000, 20)) and hits / (20 * 150) >= 0.9


def test_neighbours_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r[0], r[1], r[2]) for r in neighbours.nearest(few, lambda i: i % 20 == 0).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.nearest(few.limit(0), lambda i: i % 20 == 0).count() == 0


def test_pigeonhole_finds_every_code():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 65536, (4000, 4)).astype(np.uint16)
    index = neighbours.BlockIndex(codes)
    for radius in (0, 5, 18, 23, 31):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[7]).sum(1, dtype=np.int64) <= radius)
        assert (index.within(codes[7], radius) == want).all()


def test_mixing_meets_the_targets(spark):
    rng, kinds = random.Random(12), {"q1t0": "calm", "q0t0": "junk##", "q1t1": "rude"}
    texts, labels = [], []
    for i in range(600):
        domain = rng.choice(["q1t0"] * 6 + ["q0t0"] * 2 + ["q1t1"])
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(5, 80))]
        texts.append((i, " ".join(words + [kinds[domain]] * rng.randrange(1, 4))))
        if i % 2:
            labels.append((i, int(domain[1]), int(domain[3])))
    docs, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    p = mixing.MixParams(weights={"q1t0": 0.5, "q0t0": 0.3, "q1t1": 0.2}, min_documents=5)
    rates = mixing.mixing_rates(docs, known, p).cache()
    assert rates.where("rate < 0 OR abs(copies - rate) > 1").count() == 0
    totals = rates.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i] * F.col("rate")).alias(f"s{i}") for i in range(3)]).first()
    assert np.allclose([t / sum(totals) for t in totals], [0.3, 0.5, 0.2], atol=1e-4)  # in the order of the names
    seen = rates.join(mixing.labelled(known).withColumnRenamed("domain", "truth"), "doc_id")
    assert seen.agg(F.avg((F.col("domain") == F.col("truth")).cast("int"))).first()[0] > 0.9


def test_mixing_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (6, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert mixing.mixing_rates(odd, labels).count() == odd.count()
    mixed = mixing.mix(odd, labels)
    assert mixed.columns == odd.columns and mixed.where("doc_id IS NULL").count() == 1
    empty = labels.limit(0)
    assert mixing.mix(odd, empty).count() == odd.count() and mixing.mix(none, empty).count() == 0


def test_passages_with_changes_whose_parts_lie_in_earlier_documents(spark):
    """Each piece of ten words lies in an earlier document of its own, so no two seeds are first in the document that has the passage."""
    rng = random.Random(13)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    texts, late, wanted = [], [], set()
    for _ in range(30):
        whole = fresh(100)
        texts += [fresh(60) + whole[i : i + 10] for i in range(0, 100, 10)]
        changed = [w if (i + 1) % 10 else "zz" for i, w in enumerate(whole)]
        late += [fresh(5) + whole + fresh(30), fresh(40) + changed + fresh(7)]
    for i in range(0, len(late), 2):
        wanted.add((len(texts) + i + 1, len(texts) + i))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + late)], "doc_id long, text string")
    got = passages.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} <= wanted and len(got) >= 29
    assert all(r["matched"] >= 75 for r in got)
    assert len({(r["doc_id"], r["other_id"]) for r in got}) == len(got)


def test_open_seeds_meet_every_earlier_holder(spark):
    """Two seeds with other words between them pair all their holders, in parts; with the same words the first alone; and places that a
    passage covers none."""
    seeds = lambda before: [(7, 10 << 32 | 5), (8, 20 << 32 | before)]
    rows = [(key, node, spot, 1) for node, before in ((1, 100), (2, 200), (3, 100), (4, 300), (5, 200)) for key, spot in seeds(before)]
    shared = spark.createDataFrame(rows, "key long, node long, spot long, first long")
    found = spark.createDataFrame([(5, 1, 0, 60, 0, 60, 60)], passages.FOUND)
    nodes = spark.range(1, 6).withColumnRenamed("id", "node")
    for chunk in (1, 1024):
        pairs = passages.open_pairs(shared, found, nodes, passages.PassageParams(chunk=chunk)).collect()
        assert sorted(map(tuple, pairs)) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
