"""Texts that their provider cut off.

A text that closes with a plain end of a sentence is whole: nothing of its sentence
is missing. Every other text is looked for in the others. Min-hash banding over
windows finds them: each window of WINDOW runs of RUN words is a band whose key is
the least hash of its runs, so a text that holds another's closing words has the
band of these words too, however much of the rest differs or is missing. A pair
with one key is verified on all words from the key to the end of the shorter text,
then aligned: if the copy goes on within the word or sentence, the text was cut; if
the copy ends a sentence or line there, it is whole; more distinct continuations
decide.

Texts without such a copy are scored by how they close. An ellipsis, an entity cut
open, an unfinished bracket, an abbreviation's point: cut. A number and a point: by
the share of such numbers after this word, over the corpus, that end there and do not
go on as a decimal (after any word, where this one was never seen so). An unterminated last segment: by its terminality, the share of
all segments beginning with these words that end with them; so headings are whole
and broken sentences are not. List items, links and source lines are whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.sentences import NEVER
from corpusloom.llm.shingles import mix, word_spans
from corpusloom.sources.tables import broadcast_if_small, cut, stored

#: Words of a run and runs of a window: closing words that a copy must share are at most RUN + WINDOW - 1.
RUN, WINDOW = 6, 8
#: Last words left out of the verified run: one may be a fragment, one an appended mark.
LOOSE = 2
#: What stands for the end of a text in what follows in a copy.
END = "\x03"
#: Longest last line taken for a heading, in characters, the terminality it needs, and its least number of ends in texts that differ before it.
HEADING, TERMINAL, SEEN = 60, 0.5, 3
#: Lengths of the beginnings on which segments are joined.
LADDER = (4, 8, 16, 32)
#: Texts that hold a wanted band up to which these are broadcast with their bands (about 400 bytes each).
HOLDERS = 50_000
WHOLE, CUT, OPEN = 0, 1, 2
#: Texts worked on at once.
STEP = 2000

_MARKS = re.compile(r"(?:\.{2,}|…|\[\s*(?:\.{3}|…)\s*\]|�|&#?\w{0,7})$")
_DONE = re.compile(r"[.!?。！？।؟][\"”“»’')\]]*$")
_SEGMENT = re.compile(r"(?:[.!?…。！？][\"”»’)\]]*|\[\.\.\.\])\s+(?=[^\sa-z])|\n+")
_NUMBER_END = re.compile(r"([^\W\d_]+)\W{1,3}\d{1,3}\.$")
_NUMBER = re.compile(r"(?<!\d)\d{1,3}\.(\d|\s)")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)\W{1,3}$")
_LINES = re.compile(r"^(?:[-•*–]\s+\S.*|\d{1,2}[.)]\s+\S.*|(?:source|quelle|fuente|fonte|src)\s*:\s?\S.*\d{4}|[—–]\s*\S.*(?:newsroom|press office|redaktion|desk|agency)|.*(?:https?://|www\.)\S+|.*\b[\w-]+(?:\.[\w-]+)+/\S+)$", re.I)


def closing(text: str | None) -> tuple[int, str]:
    """(verdict, last segment): WHOLE at a plain end of a sentence; CUT, or OPEN where the corpus decides, if no copy says more.

    None and blank texts are WHOLE: nothing of them was cut.
    """
    t = (text or "").rstrip()
    if not t:
        return WHOLE, ""
    if _MARKS.search(t[-12:]):
        return CUT, ""
    if m := _DONE.search(t):
        word = re.search(r"(\S*)$", t[: m.start()])[1].lstrip("(“\"«„‘")
        if m[0][0] == ".":
            low = word.lower().strip(".")
            before = t[max(0, m.start() - 40) : m.start()]
            if low in NEVER or low in ("i.e", "e.g", "z.b", "d.h", "p.ex", "p.ej", "no", "nr") or re.search(r"\b(?:z\. B|d\. h|u\. a|p\. ex|p\. ej|i\. e|e\. g)$", before):
                return CUT, ""
            if len(word) == 1 and word.isalpha() and word.isupper() and not re.search(r"(?:\d|vitamin[ea]?)[\s  ]*\w$", before, re.I):
                return CUT, ""
            if (n := _NUMBER_END.search(t[-60:])) and m[0] == ".":  # the rest of a decimal may be missing
                return OPEN, f"\0number {n[1].lower()}|"
        if t.count("“") > t.count("”") and "“" in t[-200:] and m[0][-1] not in "”\"":
            return OPEN, ""
        return WHOLE, ""
    last = [m.end() for m in _SEGMENT.finditer(t)]
    begin = last[-1] if last else 0
    segment = t[begin:]
    if segment[-1] in ")]":  # a bracketed line of its own, or the end of a bracket within a sentence
        lone = re.search(r"(^|[.!?…。！？”»\"’)\]]\s+|\n\s*)[(\[][^()\[\]]*[)\]]$", t)
        return (WHOLE if lone else CUT), ""
    if segment[-1] in "”»\"" and segment[0] in "“«\"":
        return WHOLE, ""
    if segment[-1] in ",;-–—(=“„«[/&" or not segment[0].isascii() and segment[0] in "“«„":
        return CUT, ""
    if _LINES.match(segment):
        return OPEN, "\0line"
    return OPEN, segment if len(segment) <= HEADING else ""


_WORD = re.compile(r"[^\W_]+")


def aligned(rest: str, other: str) -> int:
    """`rest` ends a text, `other` is what a copy has in its place: CUT if the copy goes on within the word or
    sentence; WHOLE if it ends a sentence or line there; OPEN if the two differ or neither goes on (END in `other`)."""
    marked = bool(_MARKS.search(rest.rstrip()[-12:]))
    own = list(_WORD.finditer(rest.lower()))
    theirs = list(_WORD.finditer(other.lower()))
    if not own or len(theirs) < len(own):
        return OPEN
    for x, y in zip(own[:-1], theirs, strict=False):
        if x[0] != y[0] or ("\n" in rest[: x.start()]) != ("\n" in other[: y.start()]):
            return OPEN
    x, y = own[-1], theirs[len(own) - 1]
    if ("\n" in rest[: x.start()]) != ("\n" in other[: y.start()]):
        return OPEN
    if x[0] != y[0]:
        return CUT if y[0].startswith(x[0]) and not rest[x.end() :].strip(" .…[]-") else OPEN
    after, close = other[y.end() :], rest[x.end() :].strip()
    if END in after and not _WORD.search(after):  # the copy's own end, which may be cut alike
        return OPEN
    if marked:
        return WHOLE if _MARKS.match(after.strip()[:3]) else CUT
    ended = re.search(r"[.!?。！？।]", close)
    if re.match(r"[\"”»’)\]]*[.!?。！？।](?!\d)[\"”»’)\]]*(?:\s|$)", after):
        return WHOLE if ended else CUT  # a lost full stop is a lost end
    if re.match(r"[^\S\n]*\n", after):
        return WHOLE
    return WHOLE if ended and not re.match(r"[.,]\d", after) else CUT


class Bands:
    """Words, runs and bands of some texts: `at` are the first words of the bands' least runs, `owner` their texts."""

    def __init__(self, texts: list[str]) -> None:
        self.word, doc, self.start, self.stop = word_spans(texts)
        self.first = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.shown = [t if len(t) == len(t.lower()) else t.lower() for t in texts]  # what offsets count in
        n = max(0, len(self.word) - RUN + 1)
        self.run = np.zeros(n, np.uint64)
        for k in range(RUN):
            self.run = mix(self.run + self.word[k : n + k] + np.uint64(k + 1))
        self.at = self.owner = np.zeros(0, np.int64)
        if n >= WINDOW:
            view = np.lib.stride_tricks.sliding_window_view(self.run, WINDOW)
            inside = doc[: len(view)] == doc[RUN + WINDOW - 2 :]
            self.at = np.unique((view.argmin(axis=1) + np.arange(len(view)))[inside])
            self.owner = doc[self.at]

    def keys(self) -> np.ndarray:
        return self.run[self.at].astype(np.int64)

    def closing(self, i: int) -> tuple[int, int, int, str] | None:
        """(band, words verified beyond RUN, their hash, rest) of the closing words of text i; None if it is too short."""
        last = int(self.first[i + 1]) - LOOSE - RUN  # the last run that leaves the loose words out
        if last - WINDOW + 1 < self.first[i]:
            return None
        begin = last - WINDOW + 1 + int(self.run[last - WINDOW + 1 : last + 1].argmin())
        verified = _prefix_hashes(self.word, np.array([begin]))[0, last - begin]
        return int(self.run[begin].astype(np.int64)), last - begin, int(verified), self.shown[i].rstrip()[self.stop[self.first[i + 1] - LOOSE - 1] :]

    def after(self, i: int, word: int) -> str:
        """What follows `word` in its text i: one word more than are loose, and what stands up to the next."""
        stop, ahead = int(self.stop[word]), word + LOOSE + 2
        if ahead < self.first[i + 1]:
            return self.shown[i][stop : int(self.start[ahead])]
        return self.shown[i][stop:] + END


def _prefix_hashes(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For the runs that begin at `at`, hashes of their first RUN, RUN + 1, ... words, one column each."""
    out, h = [], np.zeros(len(at), np.uint64)
    for k in range(RUN + WINDOW - 1):
        h = mix(h + word[np.minimum(at + k, len(word) - 1)] + np.uint64(k + 7))
        if k >= RUN - 1:
            out.append(h)
    return np.stack(out, 1).astype(np.int64)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's bands; of rows that may be cut also verdict, segment, and the band, hash and rest of their closing words."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            part = batch.slice(lo, STEP)
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = [closing(t) for t in texts]
            b = Bands(texts)
            ends = np.searchsorted(b.owner, np.arange(len(texts) + 1)).astype(np.int32)
            tails = [(b.closing(i) if verdict != WHOLE else None) or (None, None, None, None) for i, (verdict, _) in enumerate(found)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([v for v, _ in found], pa.int32()), pa.array([g for _, g in found], pa.string()),
                    *(pa.array([t[k] for t in tails], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(b.keys())),
                ],
                names=["row_id", "verdict", "segment", "band", "more", "tail", "rest", "bands"],
            )


def _continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, tail, other): for every wanted band of a text, each closing run it may verify, by its length, and what follows there."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            part = batch.slice(lo, STEP)
            b = Bands([t or "" for t in part.column(0).to_pylist()])
            lengths = [{h["band"]: h["lengths"] for h in x} for x in part.column(1).to_pylist()]
            mask = np.fromiter((lengths[i].get(k, 0) for k, i in zip(b.keys().tolist(), b.owner.tolist(), strict=True)), np.int64, len(b.at))
            use = mask > 0
            at, owner, mask = b.at[use], b.owner[use].tolist(), mask[use].tolist()
            hashes = _prefix_hashes(b.word, at).tolist() if len(at) else []
            ends, keys = b.first[1:].tolist(), b.run[at].astype(np.int64).tolist() if len(at) else []
            rows = [(k, h[c], b.after(i, begin + RUN + c - 1)) for k, begin, i, h, bits in zip(keys, at.tolist(), owner, hashes, mask, strict=True) for c in range(WINDOW) if bits >> c & 1 and begin + RUN + c <= ends[i]]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["band", "tail", "other"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        verdict = [aligned(r, o) for r, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(verdict, pa.int32())], names=["row_id", "vote"])


def copy_votes(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """row_id, cuts, ends: of the rows that may be cut, how many distinct continuations in other texts go on, or end there.

    Only texts that hold a wanted band are read again. Equal continuations of one
    closing run count once, so a phrase that many texts share is one row a
    continuation, not one a text.
    """
    tails = facts.filter("band is not null").select("row_id", "band", "more", "tail", "rest")
    bands = broadcast_if_small(stored(tails.groupBy("band").agg(F.bit_or(F.expr("shiftleft(1, more)")).alias("lengths"))))
    holders = facts.select("row_id", F.explode("bands").alias("band")).join(bands, "band").groupBy("row_id").agg(F.collect_list(F.struct("band", "lengths")).alias("held"))
    texts = rows.join(broadcast_if_small(stored(holders), HOLDERS), "row_id").select("text", "held")
    wanted = broadcast_if_small(tails.select("band", "tail").distinct())
    others = texts.mapInArrow(_continuations, "band long, tail long, other string").join(wanted, ["band", "tail"], "left_semi").distinct()
    votes = tails.join(others, ["band", "tail"]).select("row_id", "rest", "other").mapInArrow(_votes, "row_id long, vote int")
    return votes.groupBy("row_id").agg(F.count_if(F.col("vote") == CUT).alias("cuts"), F.count_if(F.col("vote") == WHOLE).alias("ends"))


def _segment_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a text: their first HEADING + 1 characters, how often, and a hash of what stands before (least and greatest).

    Numbers with a point come the same way, as '\0number word' with '.' if they end there.
    """
    import xxhash

    for batch in batches:
        heads: dict[str, list[int]] = {}
        for text in batch.column(0).to_pylist():
            t = (text or "").rstrip()
            own = xxhash.xxh64_intdigest(t) - (1 << 63)
            seen = [t[s : s + HEADING + 1].split("\n", 1)[0] for s in (0, *(m.end() for m in _SEGMENT.finditer(t)))]
            for m in _NUMBER.finditer(t):
                if w := _WORD_BEFORE.search(t[max(0, m.start() - 40) : m.start()]):
                    seen += [f"\0number {word}|{'.' if m[1].isspace() else ''}" for word in (w[1].lower(), "*")]
            for head in seen:
                if head:
                    held = heads.setdefault(head, [0, own, own])
                    held[0] += 1
                    held[1], held[2] = min(held[1], own), max(held[2], own)
        n, lo, hi = zip(*heads.values(), strict=True) if heads else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(heads), pa.string()), *(pa.array(x, pa.int64()) for x in (n, lo, hi))], names=["head", "n", "lo", "hi"])


def terminality(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """segment, terminality, ended, varied: of all segments that begin with these characters, the share that end with them.

    `segments` (distinct strings) are joined to segment beginnings by the longest of
    the LADDER of beginnings that they fill; a line's end counts as an end. `varied`
    says that what stands before the ends differs, so copies of one text alone make
    no heading. '\0number word' is a number after that word. Counts cover every text.
    """
    heads = texts.mapInArrow(_segment_starts, "head string, n long, lo long, hi long").groupBy("head").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rungs = F.array(*(F.lit(n) for n in LADDER))
    fits = F.array_max(F.filter(rungs, lambda n: n <= F.length("segment")))
    wanted = segments.filter(F.length("segment") >= LADDER[0]).withColumn("k", F.substring("segment", F.lit(1), fits)).select("segment", "k")
    begins = heads.withColumn("k", F.explode(F.transform(F.filter(rungs, lambda n: n <= F.length("head")), lambda n: F.substring("head", F.lit(1), n))))
    joined = begins.join(broadcast_if_small(wanted, 20_000), "k").filter(F.expr("startswith(head, segment)"))
    end = F.col("head") == F.when(F.col("segment").startswith("\0number"), F.concat("segment", F.lit("."))).otherwise(F.col("segment"))
    counted = joined.groupBy("segment").agg(
        F.sum("n").alias("all"), F.sum(F.when(end, F.col("n")).otherwise(0)).alias("ended"), (F.min(F.when(end, F.col("lo"))) < F.max(F.when(end, F.col("hi")))).alias("varied")
    )
    return counted.select("segment", (F.col("ended") / F.col("all")).alias("terminality"), "ended", F.coalesce("varied", F.lit(False)).alias("varied"))


def judged(rows: DataFrame) -> DataFrame:
    """row_id, cut, branch of every row that is not plainly whole; branch: 'copy', 'closing' or 'terminality' decided.

    `rows`: row_id long, text string; nothing else is read. Rows without either have
    no result; equal texts get one answer; texts of fewer than RUN + WINDOW + LOOSE - 1
    words are judged by their closing alone; an empty table gives no row.
    """
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & F.col("row_id").isNotNull())
    facts = stored(rows.mapInArrow(_facts, "row_id long, verdict int, segment string, band long, more int, tail long, rest string, bands array<long>"))
    unsure = facts.filter(F.col("verdict") != WHOLE).select("row_id", "verdict", "segment")
    votes = copy_votes(rows, facts)
    asked = unsure.filter((F.col("verdict") == OPEN) & (F.col("segment") != "") & (F.col("segment") != "\0line")).select("segment").distinct()
    numbers = F.col("segment").startswith("\0number")
    share = cut(terminality(rows.select("text"), asked.unionByName(asked.filter(numbers).select(F.lit("\0number *|").alias("segment"))).distinct()))
    anywhere = share.filter(F.col("segment") == "\0number *|").first()  # one row
    decided = unsure.withColumn("numbered", numbers).join(votes, "row_id", "left").join(share, "segment", "left")
    heading = (F.col("terminality") >= TERMINAL) & (F.col("ended") >= SEEN) & F.col("varied")
    ends = F.coalesce("terminality", F.lit(anywhere["terminality"] if anywhere else 1.0)) >= TERMINAL  # after a word never seen before a number: as after any word
    alone = F.when(F.col("verdict") == CUT, True).when(F.col("segment") == "\0line", False).when(F.col("numbered"), ~ends).otherwise(~F.coalesce(heading, F.lit(False)))
    by_copy = F.coalesce(F.col("cuts") != F.col("ends"), F.lit(False))
    branch = F.when(by_copy, "copy").when(F.col("verdict") == CUT, "closing").otherwise("terminality")
    return decided.select("row_id", F.when(by_copy, F.col("cuts") > F.col("ends")).otherwise(alone).alias("cut"), branch.alias("branch"))


def truncated(rows: DataFrame) -> DataFrame:
    """row_id of rows whose text was cut; null, empty and blank texts are whole. See `judged`."""
    return judged(rows).filter("cut").select("row_id").distinct()


def p6_found(chunks: DataFrame) -> DataFrame:
    """row_id of pool chunks whose text was cut."""
    return truncated(chunks.select("row_id", "text"))


def cut_share(chunks: DataFrame) -> DataFrame:
    """provider, chunks, cut, share: how often each provider cuts."""
    found = truncated(chunks.select("row_id", "text")).withColumn("was_cut", F.lit(1))
    rows = chunks.select("row_id", F.col("source.provider").alias("provider"))
    return (
        rows.join(found, "row_id", "left").groupBy("provider").agg(F.count("*").alias("chunks"), F.count("was_cut").alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("chunks"), 6))
    )


def branches(chunks: DataFrame) -> DataFrame:
    """branch, cut, chunks: how many rows that are not plainly whole each branch of the method decides, and how."""
    return judged(chunks.select("row_id", "text")).groupBy("branch", "cut").agg(F.count("*").alias("chunks"))
