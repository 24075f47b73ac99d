"""Lines that repeat earlier lines, exactly or within a few edits.

Distinct lines are cut into one segment more than edits are allowed.  Two lines within the bound share one
segment, shifted by no more than the edits to its left or right leave room for, and their lengths differ by
no more than the bound.  So every line is indexed by its segments and probes, for its own and each slightly
smaller length, the substrings that can match (Li, Deng, Wang, Feng: Pass-Join, 2011).  Pairs that meet are
verified with a banded bit-parallel edit distance (Hyyro, 2003).  Everything is a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.words import has_word, lines_of
from topicloom.runtime import discard, materialise, once


@dataclass(frozen=True)
class LineParams:
    """Lines shorter than ``min_chars`` are not compared within edits: two edits make another word of a short one.

    Those of ``min_exact`` characters or more go when they equal an earlier line; ``min_chars`` holds for these too where it is None.
    """

    edits: int = 2
    min_chars: int = 20
    min_exact: int | None = None

    @property
    def least(self) -> int:
        return self.min_chars if self.min_exact is None else min(self.min_exact, self.min_chars)


# exact repeats at every length, as the query and the pipeline run it
EVERY_LINE = LineParams(min_exact=1)


def segments(length: Column, p: LineParams) -> list[tuple[Column, Column]]:
    """0-based start and size of the segments of a line; the later ones are longer by one where it doesn't divide."""
    n = p.edits + 1
    size, longer = F.floor(length / n).cast("int"), (length % n).cast("int")
    out = []
    for i in range(n):
        before = F.greatest(F.lit(0), F.lit(i - n) + longer)
        own = size + (longer > n - 1 - i).cast("int")
        out.append((size * i + before, own))
    return out


def key(line: Column, i: int, length: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(i), length, F.substring(line, start + 1, size))


def index_keys(line: str, n: str, p: LineParams) -> Column:
    """Keys of the segments of a line of length ``n``."""
    length = F.col(n)
    return F.array(*[key(F.col(line), i, length, start, size) for i, (start, size) in enumerate(segments(length, p))])


def probe_keys(line: str, n: str, p: LineParams) -> Column:
    """Keys of the substrings of a line that can equal a segment of an indexed line of the same or a smaller length.

    Segment ``i`` counts when it is the first without an edit seen from the left, or from the right: at most ``i``
    edits lie before it and ``edits - i`` after it, both within the difference in length.  A line's own segments are
    left out: those are its index keys.
    """
    own, keys = F.col(n), []
    for less in range(p.edits + 1):
        for i, (start, size) in enumerate(segments(own - less, p)):
            low = max(-i, less - (p.edits - i))
            high = min(i, less + (p.edits - i))
            for shift in range(low, high + 1):
                if less == shift == 0:
                    continue
                at = start + shift
                keys.append(F.when((own - less >= p.min_chars) & (at >= 0) & (at + size <= own), key(F.col(line), i, own - less, at, size)))
    return F.array(*keys)


LETTERS = ("enitarosldcumphg", "fybkvw0123456789")  # any sixteen each serve


def letter_counts(line: Column, letters: str) -> Column:
    """How often sixteen letters occur, each modulo 16 in four bits."""
    one = lambda i, c: F.shiftleft((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(15)), 4 * i)
    return reduce(lambda a, b: a.bitwiseOR(b), [one(i, c) for i, c in enumerate(letters)])


def counts_apart(a: str, b: str) -> Column:
    """Sum of the differences of two letter counts, the shorter way round; an edit adds two at most."""
    apart = lambda i: F.shiftrightunsigned(F.col(a), 4 * i).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(F.col(b), 4 * i).bitwiseAND(F.lit(15))
    return reduce(lambda x, y: x + y, [F.least(F.abs(apart(i)), 16 - F.abs(apart(i))) for i in range(16)])


def letters_apart(a: str, b: str) -> Column:
    """The number of letters whose counts differ: never more than ``counts_apart``, and cheap."""
    x = F.col(a).bitwiseXOR(F.col(b))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def shared_prefix(a: Column, b: Column, limit: Column) -> Column:
    """Characters that two strings share at their start, up to ``limit``: halving steps over substrings."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.pow(F.lit(2), 30 - i).cast("int"))
    grow = lambda n, s: F.when((n + s <= limit) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s)), n + s).otherwise(n)
    return F.aggregate(F.filter(steps, lambda s: s <= limit), F.lit(0), grow)


def edit_distance(pairs: DataFrame, a: str, b: str, limit: int, name: str = "distance") -> DataFrame:
    """``pairs`` with the edit distance of two strings, or ``limit + 1`` where it is larger.

    Equal ends are cut off.  The rest runs along the diagonal: bit ``r`` of a word stands for row ``column -
    limit + r``, ``up`` and ``down`` mark where the distance rises or falls to the next row.  The distance is followed
    on the lowest row of the band, then along the last row.  Columns are skipped once the bound is out of reach.
    """
    k, mask, rest = limit, (1 << (2 * limit + 1)) - 1, list(pairs.columns)
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    swap = F.length(x) < F.length(y)
    df = pairs.select(*rest, F.when(swap, y).otherwise(x).alias("_p"), F.when(swap, x).otherwise(y).alias("_t"))
    df = df.withColumn("_same", shared_prefix(F.col("_p"), F.col("_t"), F.length("_t")))
    cut = lambda c: F.expr(f"substring({c}, _same + 1)")
    df = df.select(*rest, cut("_p").alias("_p"), cut("_t").alias("_t"))
    df = df.withColumn("_same", shared_prefix(F.reverse("_p"), F.reverse("_t"), F.length("_t")))
    chars = lambda c: F.expr(f"filter(split(left({c}, length({c}) - _same), ''), c -> c <> '')")
    df = df.select(*rest, chars("_p").alias("_p"), chars("_t").alias("_t"))
    df = df.select(*rest, "_p", "_t", F.size("_p").alias("_m"), F.size("_t").alias("_n"))
    bit = " | ".join(f"IF(get(_p, j - {k} + {r} - 1) <=> get(_t, j - 1), {1 << r}L, 0L)" for r in range(2 * k + 1))
    found = f"named_struct('up', s.up, 'down', s.down, 'd', s.d, 'same', {bit})"
    diagonal = "((((u.same & u.up) + u.up) ^ u.up) | u.same | u.down)"
    # nested single-element transforms name the intermediate words
    step = f"""
      IF(s.d > {2 * k} + {k} + 1, s,
        element_at(transform(transform(transform(array({found}),
          u -> named_struct('up', u.up, 'down', u.down, 'd', u.d, 'diag', {diagonal} & {mask}L)),
          u -> named_struct('d', u.d, 'diag', u.diag, 'right', (u.down | ~(u.diag | u.up)) & {mask}L, 'left', u.diag & u.up)),
          u -> named_struct(
            'up', (u.left | ~(shiftright(u.diag, 1) | u.right)) & {mask}L,
            'down', shiftright(u.diag, 1) & u.right,
            'd', CAST(u.d + IF(j <= _m - {k}, IF((u.diag & {1 << (2 * k)}L) = 0, 1, 0),
                   IF((u.right & shiftleft(1L, _m - j + {k})) <> 0, 1, 0) - IF((u.left & shiftleft(1L, _m - j + {k})) <> 0, 1, 0)) AS INT))), 1))"""
    start = f"named_struct('up', {((1 << (k + 1)) - 1) << k}L, 'down', 0L, 'd', {k})"
    banded = f"aggregate(sequence(1, _n), {start}, (s, j) -> {step}, s -> least(s.d, {k + 1}))"
    # cores no longer than the band are left to the built-in distance
    value = f"CASE WHEN _m - _n > {k} THEN {k + 1} WHEN _n = 0 THEN _m WHEN _m <= {k} THEN least(levenshtein(array_join(_p, ''), array_join(_t, '')), {k + 1}) ELSE {banded} END"
    # a later filter on the distance must not pull the whole expression below these steps
    return once(df, name, F.expr(value).cast("int")).select(*rest, name)


def lines_in(docs: DataFrame) -> DataFrame:
    """``(doc_id, v, at, line)`` for every line of every text; ``v`` is the hash of the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("v"), F.posexplode(lines_of("text")).alias("at", "line"))


def considered(line: Column, p: LineParams) -> Column:
    return (F.length(line) >= p.min_chars) & has_word(line)


def near_pairs(docs: DataFrame, firsts: DataFrame, p: LineParams) -> DataFrame:
    """Links between distinct lines within the bound: ``(h_a, doc_a, h_b, doc_b)``, each with its first document.

    ``firsts``: ``(h, g, first, n)`` of every distinct line.  Lines that make up a thousandth of all, of which there
    are a thousand at most, are keyed in their first document only; what is left of repeated keys is dropped where they meet.
    """
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = firsts.where(F.col("n") * 1000 >= total).where("n > 1").select(F.col("h").alias("_h"), F.col("first").alias("_first")).limit(1000)
    own_lines = docs.select("doc_id", F.explode(F.array_distinct(lines_of("text"))).alias("line"))
    lines = own_lines.where(considered(F.col("line"), p)).select("doc_id", "line", F.length("line").alias("n"), F.xxhash64("line").alias("h"))
    lines = lines.join(F.broadcast(hot), F.col("h") == F.col("_h"), "left").where("_first IS NULL OR _first = doc_id")
    # one row for each key of a line; only those whose key another line has as well go on
    tagged = lambda keys, indexed: F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(indexed).alias("indexed")))
    rows = lines.select("h", F.explode(F.concat(tagged(index_keys("line", "n", p), True), tagged(probe_keys("line", "n", p), False))).alias("x"))
    rows = rows.select("x.k", "h", "x.indexed").where("k IS NOT NULL").repartition("k")
    of_key = Window.partitionBy("k")
    shared = (F.min("h").over(of_key) < F.max("h").over(of_key)) & F.max("indexed").over(of_key)
    keys = materialise(rows.withColumn("shared", shared).where("shared").select("k", "h", "indexed").distinct(), "met-keys")
    wanted = keys.select("h").distinct()
    places = materialise(firsts.join(wanted, "h").groupBy("h").agg(F.min("first").alias("doc")), "met-places")
    of_docs = places.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("h").alias("hs"))  # lines of one document
    texts = docs.join(of_docs.hint("merge"), "doc_id").select("doc_id", keep_lines("text", "hs").alias("text"))
    texts = lines_in(texts).select(F.xxhash64("line").alias("h"), "line").dropDuplicates(["h"]).join(places, "h")
    texts = materialise(texts, "met-texts")
    # lines of one form that differ by a word or more meet on many segments; most end inside this join, as their letters differ
    counts = texts.select("h", *[letter_counts(F.col("line"), x).alias(f"c{i}") for i, x in enumerate(LETTERS)])
    signed = keys.join(counts, "h")
    side = lambda x: signed.select("k", "indexed", *[F.col(c).alias(f"{c}_{x}") for c in ("h", "c0", "c1")])
    alike = letters_apart("c0_a", "c0_b") + letters_apart("c1_a", "c1_b") <= 2 * p.edits
    alike &= counts_apart("c0_a", "c0_b") + counts_apart("c1_a", "c1_b") <= 2 * p.edits
    # two index keys meet both ways round
    once_each = (F.col("h_a") < F.col("h_b")) | ((F.col("h_a") != F.col("h_b")) & ~F.col("indexed"))
    met = side("a").where("indexed").drop("indexed").join(side("b"), "k").where(once_each & alike)
    met = met.select(F.least("h_a", "h_b").alias("h_a"), F.greatest("h_a", "h_b").alias("h_b")).distinct()
    met = materialise(met, "met-lines")
    of = lambda x: texts.select(F.col("h").alias(f"h_{x}"), F.col("doc").alias(f"doc_{x}"), F.col("line").alias(x))
    half = met.join(of("a"), "h_a").alias("x")
    # pairs far beyond the bound end inside the join, so that only few leave it
    close = F.levenshtein("a", "b", p.edits) >= 0
    pairs = half.join(of("b").withColumnRenamed("h_b", "_h"), (F.col("h_b") == F.col("_h")) & close).drop("_h")
    near = edit_distance(pairs, "a", "b", p.edits).where(F.col("distance") <= p.edits).select("h_a", "doc_a", "h_b", "doc_b")
    near = materialise(near, "near-lines")
    for table in (keys, met, places, texts):
        discard(table)
    return near


def keep_lines(text: str, hashes: str) -> Column:
    """A text reduced to the lines with one of the hashes."""
    return F.array_join(F.filter(lines_of(text), lambda line: F.array_contains(hashes, F.xxhash64(line))), "\n")


def dropped_lines(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """``(doc_id, drop)``: for documents that lose lines, the spots of those (see ``spot``).

    A line goes when it equals an earlier line, or, from ``min_chars`` on, is within ``edits`` of an earlier distinct one.  Lines are ordered by
    ``doc_id``, place and, where an id has several texts, the hash of the text; a distinct line counts where it is first.
    """
    place = F.struct("at", "v")
    identity = [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")]
    exact = (F.length("line") >= p.least) & has_word(F.col("line"))
    seen = lines_in(docs).where(exact).where("doc_id IS NOT NULL").select("doc_id", "v", "at", *identity)
    seen = materialise(seen, "lines")
    firsts = materialise(seen.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "first-lines")
    repeated = firsts.where("n > 1").select("h", "g", "first")
    links = materialise(near_pairs(docs.where("doc_id IS NOT NULL"), firsts, p), "near-lines")
    # within one document the place decides
    spots = seen.join(links.where("doc_a = doc_b").select(F.col("h_a").alias("h")).union(links.where("doc_a = doc_b").select("h_b")).distinct(), "h", "left_semi")
    spots = spots.groupBy("doc_id", "h").agg(F.min(place).alias("at"))
    placed = (
        links.join(spots.select(F.col("doc_id").alias("doc_a"), F.col("h").alias("h_a"), F.col("at").alias("at_a")), ["doc_a", "h_a"], "left")
        .join(spots.select(F.col("doc_id").alias("doc_b"), F.col("h").alias("h_b"), F.col("at").alias("at_b")), ["doc_b", "h_b"], "left")
    )
    a_first = (F.col("doc_a") < F.col("doc_b")) | ((F.col("doc_a") == F.col("doc_b")) & (F.col("at_a") < F.col("at_b")))
    later = placed.select(F.when(a_first, F.col("h_b")).otherwise(F.col("h_a")).alias("h")).distinct()
    again = seen.join(repeated, ["h", "g"]).groupBy("doc_id", "h", "g", "first").agg(F.min(place).alias("from"), F.collect_set(place).alias("ats"))
    again = again.select("doc_id", F.explode(F.filter("ats", lambda x: (F.col("doc_id") != F.col("first")) | (x != F.col("from")))).alias("x"))
    again = again.select("doc_id", spot("x.v", "x.at").alias("at"))
    near = seen.join(later, "h", "left_semi").select("doc_id", spot("v", "at").alias("at"))
    return again.union(near).groupBy("doc_id").agg(F.collect_set("at").alias("drop"))


def spot(v: str, at: Column | str) -> Column:
    """A place in one of the texts of an id, as one number."""
    return F.xxhash64(F.col(v), at)


def dedup_lines(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines``, ``n_dropped``.

    Lines without a word or shorter than the bounds stay.  Null and empty texts stay as they are (0 and 1 lines); a
    null ``doc_id`` keeps all its lines and drops nobody else's.  Rows that repeat an id and its text are one document: each loses
    the same lines.  Rows of one id with different texts follow each other line by line, and every distinct line of theirs stays once.  Columns
    of the two added names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    drop = dropped_lines(docs.select("doc_id", "text"), p).select(F.col("doc_id").alias("__id"), F.col("drop").alias("__drop"))
    rows = docs.select(*kept).join(drop.hint("merge"), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    lines = F.split("text", "\n")
    rows = rows.withColumn("__v", F.when(F.col("__drop").isNotNull(), F.xxhash64("text")))
    rows = rows.withColumn("__left", F.when(F.col("__drop").isNotNull(), F.filter(lines, lambda line, i: ~F.array_contains("__drop", spot("__v", i)))))
    text = F.coalesce(F.array_join("__left", "\n"), F.col("text"))
    out = [text.alias(c) if c == "text" else F.col(c) for c in kept]
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    lost = F.when(F.col("__left").isNull(), 0).otherwise(F.size(lines) - F.size("__left")).cast("long")
    return rows.select(*out, n.alias("n_lines"), lost.alias("n_dropped"))
