"""Records of held-out splits that also stand in the training split.

Records are normalised and cut where a rolling hash of the last characters says
so, hence an edit changes only the chunks around it. Chunk digests are joined
across splits and the lengths of shared chunks summed into overlap fractions.

Every pair that shares enough is found, whatever the frequency of what it shares
(`blocking.overlapping`). Pairs that share at least LEAST of the shorter record are aligned word by
word. What differs comes out as replacements (words of one record against words of
the other, or against nothing), and the corpus says what a replacement means: a
wording (one verb for another, a polite opening) is rare and nearly every record
that has it stands beside one that differs in just this, while a content word
(another substance, another group of people) stands beside many others and mostly
alone. The share of a replacement's records that have such a neighbour decides, by
its lower confidence bound; no list of words does.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.blocking import overlapping
from corpusloom.sources.tables import broadcast_if_small, stored

#: Characters of the rolling window, and one in how many places is a cut.
WINDOW, MASK = 4, 8
#: Least share of the shorter record's length in common chunks.
LEAST = 0.25
#: Lower bound of the share of a replacement's records with a neighbour, its z, how many such records an exchange of words
#: needs (one of one proves nothing there), and how much more frequent one side of it must be.
SURE, Z, SEEN, RATIO = 0.1, 1.64, 2, 10.0
#: Least share of the words of the shorter record (misspellings included) that stand in both.
WORDS = 0.75
#: Characters of one side's records up to which they are broadcast.
TEXTS = 32_000_000
#: Replacements of a pair up to which it counts as a neighbour.
FEW = 3


def normalised(text: str | None) -> str:
    """Lower case, NFKC, letters and digits separated by single blanks; '' for None."""
    if not text:
        return ""
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", text).lower()))


def cut_points(text: str, window: int = WINDOW, mask: int = MASK) -> list[str]:
    """The content-defined chunks of a normalised text; together they are the text."""
    if len(text) <= window:
        return [text] if text else []
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    rolling = np.zeros(len(codes) - window + 1, np.uint64)
    for k in range(window):
        rolling = rolling * np.uint64(0x9E3779B1) + codes[k : len(codes) - window + 1 + k]
    rolling ^= rolling >> np.uint64(29)
    rolling *= np.uint64(0xBF58476D1CE4E5B9)
    rolling ^= rolling >> np.uint64(32)
    cuts = np.flatnonzero(rolling % np.uint64(mask) == 0) + window
    edges = [0, *cuts[cuts < len(codes)].tolist(), len(codes)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        keys, sides, digests, lengths, totals = [], [], [], [], []
        for key, text, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chunks = dict.fromkeys(cut_points(text or ""))
            total = sum(map(len, chunks))
            for chunk in chunks:
                keys.append(key)
                sides.append(left)
                totals.append(total)
                digests.append(xxhash.xxh64_intdigest(chunk) - (1 << 63))
                lengths.append(len(chunk))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sides, pa.bool_()), pa.array(digests, pa.int64()), pa.array(lengths, pa.int32()), pa.array(totals, pa.int64())], names=["rec", "left", "token", "weight", "total"])


def _within(a: str, b: str, most: int) -> bool:
    """Whether `most` insertions, deletions, exchanges and swaps of neighbours make one text the other; tried from the first difference on."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    k = next((k for k in range(n) if a[k] != b[k]), n)
    a, b = a[k:], b[k:]
    if not a or not b or not most:
        return len(a) + len(b) <= most
    if _within(a[1:], b[1:], most - 1) or _within(a[1:], b, most - 1) or _within(a, b[1:], most - 1):
        return True
    return a[0] == b[1:2] and a[1:2] == b[0] and _within(a[2:], b[2:], most - 1)


def _near(a: str, b: str) -> bool:
    """Edit distance (with swaps) of at most 1, or 2 for words of 9 letters and more."""
    most = 2 if min(len(a), len(b)) >= 9 else 1
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > most or a.isdigit() or b.isdigit() or len(set(a) ^ set(b)) > 2 * most:
        return False
    return _within(a, b, most)


@lru_cache(maxsize=1 << 18)
def _alike(a: str, b: str) -> bool:
    """`_near`, with answers kept: most words of questions are few."""
    return abs(len(a) - len(b)) <= 2 and _near(a, b)


def replaced(a: str, b: str) -> list[tuple[str, str, bool]]:
    """(words of a, words of b, whether one is a misspelling of the other) wherever two normalised texts differ.

    Words are compared as bags first, so a moved clause is no difference. What is
    left is joined to runs, and runs beside the same common word answer each other.
    """
    x, y = a.split(), b.split()
    left, right = Counter(x) - Counter(y), Counter(y) - Counter(x)
    out: list[tuple[str, str, bool]] = []
    for w in list(left.elements()):
        v = next((v for v in right if right[v] > 0 and _alike(w, v)), None)
        if v is not None:
            left[w] -= 1
            right[v] -= 1
            out.append((w, v, True))
    ours, theirs = _runs_of(x, left), _runs_of(y, right)
    if "".join(r[2] for r in ours).replace(" ", "") == "".join(r[2] for r in theirs).replace(" ", ""):
        return out  # a word split or joined
    alone = []
    for run in ours:
        match = next((t for t in theirs if run[0] == t[0] or run[1] == t[1]), None)
        if match is None:
            alone.append(run)
        else:
            theirs.remove(match)
            out.append((run[2], match[2], _near(run[2].replace(" ", ""), match[2].replace(" ", ""))))
    if len(alone) == 1 and len(theirs) == 1:
        return [*out, (alone[0][2], theirs[0][2], False)]
    return [*out, *((r[2], "", False) for r in alone), *(("", r[2], False) for r in theirs)]


def _runs_of(words: list[str], extra: Counter) -> list[tuple[str, str, str]]:
    """(word before, word after, run) of the runs of words that the other text has not; of repeated words those that make fewer runs."""
    forward, backward = _marked(words, extra), _marked(words[::-1], extra)[::-1]
    runs = [_spans(words, m) for m in (forward, backward)]
    return min(runs, key=len)


def _marked(words: list[str], extra: Counter) -> list[bool]:
    left, out = Counter(extra), []
    for w in words:
        out.append(left[w] > 0)
        left[w] -= out[-1]
    return out


def _spans(words: list[str], marked: list[bool]) -> list[tuple[str, str, str]]:
    runs, begin = [], None
    for k, on in enumerate([*marked, False]):
        if on:
            begin = k if begin is None else begin
        elif begin is not None:
            runs.append((words[begin - 1] if begin else "^", words[k] if k < len(words) else "$", " ".join(words[begin:k])))
            begin = None
    return runs


@lru_cache(maxsize=1 << 15)
def _words(text: str) -> tuple[list[str], frozenset[str]]:
    return (words := text.split()), frozenset(words)


@lru_cache(maxsize=1 << 17)
def _letters(word: str) -> tuple[str, int, int]:
    """The word, its length and a bit set of its letters."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 61
    return word, len(word), bits


def _any_near(ours: Iterable[str], theirs: Iterable[str]) -> bool:
    """Whether `_near` holds for any of one with any of the other; most fail by length or letters."""
    right = [_letters(t) for t in theirs]
    for w, n, bits in map(_letters, ours):
        most = 2 if n >= 9 else 1
        for v, m, other in right:
            if -most <= n - m <= most and (bits ^ other).bit_count() <= 2 * most and _near(w, v):
                return True
    return False


def _far(a: str, b: str) -> bool:
    """Whether the words of the shorter that the other has not are certain to be too many; False where slips, split words or repeated ones leave it open."""
    (x, xs), (y, ys) = _words(a), _words(b)
    if len(x) != len(xs) or len(y) != len(ys):
        return False
    left, right = xs - ys, ys - xs
    short = min(len(x), len(y))
    if len(left if len(x) <= len(y) else right) <= (1 - WORDS) * short or _any_near(left, right):
        return False
    ours, theirs = ([r[2].replace(" ", "") for r in _spans(t, [w in m for w in t])] for t, m in ((x, left), (y, right)))
    return "".join(ours) != "".join(theirs) and not _any_near(ours, theirs)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The replacements of each pair that shares WORDS of its shorter record."""
    kind = pa.list_(pa.struct([("x", pa.string()), ("y", pa.string()), ("slip", pa.bool_())]))
    for batch in batches:
        found, keep = [], []
        for k, (a, b) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            if _far(a, b):
                continue
            diffs = replaced(a, b)
            x, y = a.split(), b.split()
            other = sum(len((t[0] if len(x) <= len(y) else t[1]).split()) for t in diffs if not t[2])
            if other <= (1 - WORDS) * min(len(x), len(y)):
                keep.append(k)
                found.append([{"x": x, "y": y, "slip": slip} for x, y, slip in diffs])
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(3)), pa.array(found, kind)], names=["rec_a", "rec_b", "fraction", "diffs"])


def chunk_pairs(records: DataFrame, train: str, held: list[str], least: float = LEAST) -> DataFrame:
    """All (rec_a, rec_b, shared, fraction_a, fraction_b) across splits that share `least` of the shorter length.

    `records`: rec long (unique), split, norm. a is of `train`, b of `held`. Empty
    texts have no chunk and no pair.
    """
    sides = records.filter(F.col("split").isin(train, *held)).select("rec", "norm", (F.col("split") == train).alias("left"))
    chunks = sides.mapInArrow(_chunks, "rec long, left boolean, token long, weight int, total long").withColumn("share", F.lit(least))
    return overlapping(chunks, least).select("rec_a", "rec_b", "shared", (F.col("shared") / F.col("total_a")).alias("fraction_a"), (F.col("shared") / F.col("total_b")).alias("fraction_b"))


def _frequencies(records: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: in how many records each of the distinct `terms` (words and pairs of words) stands."""
    words = F.split("norm", " ")
    both = F.expr("concat(w, transform(filter(sequence(0, size(w) - 1), i -> i > 0), i -> concat(w[i - 1], ' ', w[i])))")
    return records.withColumn("w", words).select(F.explode(F.array_distinct(both)).alias("term")).join(broadcast_if_small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def same_by_corpus(pairs: DataFrame, records: DataFrame, sure: float = SURE, z: float = Z, seen: int = SEEN, ratio: float = RATIO, few: int = FEW) -> DataFrame:
    """Of `pairs` (rec_a, rec_b, fraction, diffs) those whose every replacement is a wording or a misspelling.

    A misspelling (one edit, two in long words) must be of a word at least twenty
    times rarer, or of one that stands in two records at most. For a replacement, m is
    the number of records with its rarer side (for an insertion, its rarest word or
    pair of words) and n how many of them stand in a pair with at most `few`
    differences that shows it; the lower bound of n / m must reach `sure`, and for an
    exchange n must be `seen` and the other side `ratio` times as frequent.
    """
    flat = stored(pairs.select("rec_a", "rec_b", "fraction", F.explode_outer("diffs").alias("t")).select(
        "rec_a", "rec_b", "fraction", F.coalesce("t.slip", F.lit(False)).alias("slip"),
        F.least("t.x", "t.y").alias("x"), F.greatest("t.x", "t.y").alias("y"), F.col("t").isNull().alias("equal"),
    ))
    few_rows = pairs.filter(F.size("diffs") <= few).select("rec_a", "rec_b", F.explode("diffs").alias("t"))
    turned = F.col("t.x") > F.col("t.y")
    held = few_rows.select(F.least("t.x", "t.y").alias("x"), F.greatest("t.x", "t.y").alias("y"), F.when(turned, F.col("rec_b")).otherwise(F.col("rec_a")).alias("with_x"), F.when(turned, F.col("rec_a")).otherwise(F.col("rec_b")).alias("with_y"))
    shown = held.groupBy("x", "y").agg(F.countDistinct("with_x").alias("nx"), F.countDistinct("with_y").alias("ny"))
    kinds = flat.filter("not equal").select("x", "y", "slip").distinct()
    pieces = "split({0}, ' ')"
    pairs_of = "transform(filter(sequence(0, size(split({0}, ' ')) - 1), i -> i > 0), i -> concat(split({0}, ' ')[i - 1], ' ', split({0}, ' ')[i]))"
    sided = kinds.select("x", "y", F.explode(F.expr(f"concat(transform({pieces.format('x')}, w -> struct(0 AS side, w AS term)), transform(if(x = '', concat({pieces.format('y')}, {pairs_of.format('y')}), {pieces.format('y')}), w -> struct(1 AS side, w AS term)))")).alias("s"))
    sided = sided.select("x", "y", "s.side", "s.term").filter("term <> ''").distinct()
    df = _frequencies(records, sided.select("term").distinct())
    rarest = sided.join(df, "term").groupBy("x", "y").agg(F.min(F.when(F.col("side") == 0, F.col("df"))).alias("dx"), F.min(F.when(F.col("side") == 1, F.col("df"))).alias("dy"))
    m = F.least("dx", "dy")  # of an insertion the one side there is
    n = F.when((F.col("x") == "") | (F.col("dy") <= F.col("dx")), F.col("ny")).otherwise(F.col("nx"))
    p = F.least(F.lit(1.0), n / m)
    low = (p + z * z / 2 / m - z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / m + z * z / 4 / m / m))) / (1 + z * z / m)
    spelt = F.col("slip") & (m <= F.greatest(F.lit(2.0), F.greatest("dx", "dy") / 20))
    worded = F.when(F.col("x") == "", low >= sure).otherwise((low >= sure) & (n >= seen) & (F.greatest("dx", "dy") >= ratio * m))
    judged = kinds.join(rarest, ["x", "y"]).join(shown, ["x", "y"], "left").fillna(0, ["nx", "ny"]).select("x", "y", "slip", (spelt | worded).alias("ok"))
    return flat.join(judged, ["x", "y", "slip"], "left").groupBy("rec_a", "rec_b").agg(F.min(F.col("equal") | F.coalesce("ok", F.lit(False))).alias("same"), F.max("fraction").alias("fraction")).filter("same").select("rec_a", "rec_b", "fraction")


@F.pandas_udf(T.StringType())
def _normal(texts):  # noqa: ANN001, ANN202
    return texts.map(normalised)


def _records(items: DataFrame, train: str) -> DataFrame:
    """One row per split side and wording, with the ids that carry it."""
    side = F.when(F.col("set_name") == train, F.lit(train)).otherwise(F.lit("held"))
    rows = items.filter(F.col("question_id").isNotNull() & F.col("set_name").isNotNull()).select(side.alias("split"), "question_id", _normal("question").alias("norm"))
    return rows.filter(F.col("norm") != "").withColumn("rec", F.xxhash64("split", "norm"))


def cross_split(items: DataFrame, train: str = "development", held: tuple[str, ...] = ("validation", "test"), least: float = LEAST) -> DataFrame:
    """question_id_a (training side), question_id_b (held out), fraction: overlapping records.

    fraction is the share of the shorter record's length that lies in common
    chunks; 1 for equal texts. Pairs below `least` are not aligned. Null ids, sets
    and questions, and questions without a letter or digit, give no pair; ids
    exported twice give a pair once; columns not named are not read. The wording is
    collapsed first, so a question repeated many times costs one record; its copies
    come back only in the joined result.
    """
    kept = items.filter(F.col("set_name").isin(train, *held))
    rows = stored(_records(kept, train))
    records = rows.select("rec", "split", "norm").distinct()
    found = chunk_pairs(records, train, ["held"], least).select("rec_a", "rec_b", F.greatest("fraction_a", "fraction_b").alias("fraction"))
    na = records.select(F.col("rec").alias("rec_a"), F.col("norm").alias("norm_a"))
    nb = records.select(F.col("rec").alias("rec_b"), F.col("norm").alias("norm_b"))
    size = records.groupBy("split").agg(F.sum(F.length("norm")).alias("n")).agg(F.max("n")).first()[0] or 0
    small = F.broadcast if size <= TEXTS else lambda df: df
    aligned = found.join(small(na), "rec_a").join(small(nb), "rec_b").select("rec_a", "rec_b", "fraction", "norm_a", "norm_b")
    aligned = stored(aligned.mapInArrow(_differences, "rec_a long, rec_b long, fraction double, diffs array<struct<x string, y string, slip boolean>>"))
    sure = same_by_corpus(aligned, records)
    ids = rows.select("rec", "question_id").distinct()
    return (
        sure.join(ids.select(F.col("rec").alias("rec_a"), F.col("question_id").alias("question_id_a")), "rec_a")
        .join(ids.select(F.col("rec").alias("rec_b"), F.col("question_id").alias("question_id_b")), "rec_b")
        .groupBy("question_id_a", "question_id_b")
        .agg(F.max("fraction").alias("fraction"))
    )


def p3_found(items: DataFrame) -> DataFrame:
    """question_id_a, question_id_b: distinct pairs asking the same across splits."""
    return cross_split(items).select("question_id_a", "question_id_b")


def overlap_report(items: DataFrame) -> DataFrame:
    """Held-out items and those also in the training split, per set, origin and category."""
    pairs = cross_split(items).select(F.col("question_id_b").alias("question_id"), "fraction").groupBy("question_id").agg(F.max("fraction").alias("fraction"))
    held = items.filter(F.col("set_name").isin("validation", "test")).groupBy("question_id").agg(*(F.min(c).alias(c) for c in ("set_name", "origin", "category")))
    return (
        held.join(pairs, "question_id", "left")
        .groupBy("set_name", "origin", "category")
        .agg(F.count("*").alias("items"), F.count("fraction").alias("overlapping"), F.round(F.avg("fraction"), 6).alias("mean_fraction"))
    )
