"""Sentence units of documents in any language and script.

Boundary rules are a finite transducer. Its state is, for each kind of quotation or
bracket, which of them are open and whether each began a unit (a small automaton,
compiled to a table of states by symbols), and the number of the last numbered line
of the paragraph. Characters with bounded context on either side give its symbols:
openings, closings, blank lines, list items, and terminators that end a sentence
given the words beside them. It emits a boundary at blank lines and items and,
outside quotations, at terminators.

An opening that nothing closes before the next blank line is a plain character, so
a second automaton reads from the right and counts the closings ahead. A long
document is cut into pieces worked on in parallel. A piece is a function from the
state at its one end to the state at the other; a scan from the right, then one from
the left compose these functions, in blocks of SPAN pieces and over the blocks, and
each piece emits its boundaries from its true states. So a quotation may be of any
length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources.tables import stored

#: Characters of a piece, of context beside it (words before, white space and closers after a mark), and pieces of a block of the scan.
PIECE, CONTEXT, SPAN = 16_384, 1_024, 256
#: Deepest nesting of one kind of quotation or bracket, and most closings told apart ahead.
DEPTH, AHEAD = 4, 15

_W = "[ \\t\\u00a0\\u1680\\u2000-\\u200b\\u202f\\u205f\\u3000\\ufeff\\r]"
_TERM = ".!?…。！？｡।॥؟۔"
_HARD = "。！？｡।॥؟۔"
_OPEN = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "‘": "’", "‚": "’‘", "‹": "›", "《": "》", "［": "］"}
_CLOSERS = "”’»“\")]」』）】›》］"
_THAI = "\\u0e01-\\u0e5b"
#: Words before a point that do not end a sentence, and those that may if a capital follows.
NEVER = frozenset("""
dr prof mr mrs ms st fig figs vol vols pp p appx approx cf vs eg e.g i.e al ed eds ch sec eq ref refs no nos
mme mlle m env av art p.ex c.-à-d éd chap tél
z d u ca vgl abb bzw evtl ggf nr str tab
pág págs cap aprox sr sra srta dra ej ee núm fig art
т.е проф рис см стр гл им ул табл
ดร ศ นพ
د أ
डॉ श्री
jan feb mar apr jun jul aug sep sept oct nov dec
""".split())  # fmt: skip
MAYBE = frozenset("etc usw inc ltd co u.s u.k u.s.a a.m p.m uu г т.д т.п jr sr.".split())
NUMBERED = frozenset("no nr fig abb pág cap appx vol pp p art рис".split())
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_ORDINAL = re.compile(r"\b(?:[Aa]m|[Dd]er|[Dd]ie|[Dd]as|[Dd]en|[Dd]em|[Dd]es|[Ii]m|[Vv]om|[Zz]um|[Zz]ur|[Bb]is)\s+\d{1,3}$")
_MARK = re.compile(rf"{_W}*(?:([•*\-‣◦▪·])(?={_W}+\S)|(\d{{1,3}})[.)](?={_W}+\S)|(?:[a-z]|[ivx]{{1,4}})\)(?={_W}+\S))")
def _skip_space(text: str, k: int) -> int:
    while k < len(text) and text[k].isspace():
        k += 1
    return k


def _ends(text: str, first: int, stop: int, unit_quote: bool, item: Callable[[int, str], bool]) -> bool:
    """Whether the terminator text[first:stop] (closers after it included up to `stop`) ends a sentence.

    `item` tells whether a number at the start of the line is the marker of a list item.
    """
    mark = text[first]
    run = text[first:stop]
    nxt = _skip_space(text, stop)
    if nxt >= len(text):
        return True
    spaced = nxt > stop
    c = text[nxt]
    closed = any(x in _CLOSERS for x in run)
    core = run.rstrip(_CLOSERS)
    if any(x in _HARD for x in core):
        if not closed:
            return True
        if unit_quote:
            return False  # a quotation at the start of its unit: the speaker follows
        return not (c.islower() or c in "—–,，、;:と")
    if core.startswith("……") and _UNCASED.match(c):
        return False
    if c in "—–,;:" and closed:
        return False
    if mark == "…" and not spaced and _UNCASED.match(c):
        return False
    word = re.search(r"[^\s(\[（“«\"„‘]*$", text[max(0, first - 24) : first])[0]
    if m := re.search(r"[^\W\d_]{3,}[.!?…]+(?=[A-Z])", word):  # a blank lost after the sentence before
        word = word[m.end() :]
    if core == ".":
        if not spaced:
            if closed:
                return bool(c.isupper() or _UNCASED.match(c))
            plain = re.search(r"[^\W\d_]{2,}$", word)
            return bool(c.isupper() and text[nxt + 1 : nxt + 2].islower() and plain and "/" not in word and "." not in word and plain[0].lower() not in NEVER and not word.isupper()) or bool(
                re.match(r"[¿¡«“„]", c) and plain
            )
        low = word.lower().lstrip("'’-").rsplit("'", 1)[-1].rsplit("’", 1)[-1]
        if not closed:
            before = text[max(0, first - 30) : first]
            if low in NEVER:
                if low in NUMBERED and not c.isdigit() and c.isupper() and low in ("no", "art"):
                    return True
                return False
            if len(word) == 1 and word.isupper() and (c.isupper() or _UNCASED.match(c)) and not re.search(r"vitamin[ea]?\s+\w$", before, re.I):
                return False
            if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word) and low not in MAYBE:
                return False
            if re.search(r"\bт\.\s*[еo]$", before):
                return False
            if re.search(r"\bd\.\s*h$|\bz\.\s*B$|\bu\.\s*a$|\bp\.\s*ex$|\bp\.\s*ej$", before):
                return False
            if low in MAYBE and low == "г":
                return c.isupper()
            if word.isdigit() and _ORDINAL.search(before) and (c.isupper()):
                return False
            if word.isdigit() and re.match(rf"(?:{MONTHS})\b", text[nxt : nxt + 12]):
                return False
            line = text.rfind("\n", 0, first) + 1
            if not text[line : first - len(word)].strip() and (re.fullmatch(r"\d{1,3}", word) and item(line, word) or re.fullmatch(r"[IVXLC]+", word)):
                return False
    if closed and unit_quote and _UNCASED.match(c):
        return False
    if c.islower():
        return bool(re.match(r"[a-z][A-Z]", text[nxt : nxt + 2])) and spaced
    if not spaced and core != ".":
        if closed:
            return bool(c.isupper() or _UNCASED.match(c))
        return bool(c.isupper() and text[nxt + 1 : nxt + 2].islower()) or c in "¿¡«“„" or bool(_UNCASED.match(c) and mark in "!?")
    return True


_EVENT = re.compile(
    rf"(?P<blank>\n{_W}*\n[\s ]*)|(?P<line>\n)|(?P<term>[{re.escape(_TERM)}]+)|(?P<quote>[{re.escape(''.join(_OPEN))}{re.escape(''.join(sorted(set(''.join(_OPEN.values())))))}\"])"
    rf"|(?P<thai>(?<=[{_THAI}]){_W}+(?=[{_THAI}]|[A-Z][a-z]))"
)
_UNCASED = re.compile(r"[֐-ࣿऀ-෿฀-໿぀-ヿ㐀-鿿가-힯]")
_BLANK = re.compile(rf"\n{_W}*\n")
_PARTS = re.compile(rf"(?P<blank>\n{_W}*\n)|(?P<quote>[{re.escape(''.join(_OPEN))}{re.escape(''.join(sorted(set(''.join(_OPEN.values())))))}\"])")
_LINE = re.compile(rf"(?P<blank>\n{_W}*\n[\s ]*)|\n")

#: Kinds by opening mark; a straight quotation mark is a kind that closes itself. FLAT ones do not nest in themselves.
KINDS = [*_OPEN, '"']
FLAT = frozenset(k for k, o in enumerate(KINDS) if o in "‘‚„\"")
OPENS = {o: k for k, o in enumerate(KINDS)}
CLOSES: dict[str, list[int]] = {}
for _k, _o in enumerate(KINDS):
    for _c in _OPEN.get(_o, '"'):
        CLOSES.setdefault(_c, []).append(_k)
_BRACKETS = "([（【［"

#: States of a kind: the open ones of it, outermost first, 1 for one that began a unit. Symbols: open within a unit, open at its start, close, reset.
STATES = [()]
for _s in STATES:
    if len(_s) < DEPTH:
        STATES += [(*_s, 0), (*_s, 1)]
_AT = {s: k for k, s in enumerate(STATES)}
OPEN0, OPEN1, CLOSE, RESET = range(4)
NESTED = np.array([[_AT[(*s, b)] if len(s) < DEPTH else _AT[s] for b in (0, 1)] + [_AT[s[:-1]], 0] for s in STATES], np.int32)
SINGLE = np.array([[_AT[s or (b,)] for b in (0, 1)] + [_AT[s[:-1]], 0] for s in STATES], np.int32)
_NEXT = [SINGLE if k in FLAT else NESTED for k in range(len(KINDS))]
_STEP = [t.tolist() for t in _NEXT]


def _zero() -> list[int]:
    return [0] * len(KINDS)


def _closes(text: str, at: int, kind: int) -> bool:
    """Whether the closing mark at `at` may close a quotation of `kind`: no apostrophe, no straight mark after white space."""
    if KINDS[kind] == '"':
        return at > 0 and not text[at - 1].isspace()
    return not (text[at] == "’" and 0 < at < len(text) - 1 and text[at + 1].isalpha() and text[at - 1].isalpha())


def _may_open(text: str, at: int) -> bool:
    return text[at] != '"' or at == 0 or text[at - 1].isspace() or text[at - 1] in "([—–"


def _ahead(text: str, lo: int, hi: int, right: list[int]) -> tuple[set[int], list[int]]:
    """(openings in [lo, hi) that something closes before the next blank line, closings ahead of each kind at lo)."""
    count, matched = list(right), set()
    for m in reversed(list(_PARTS.finditer(text, lo, min(hi + CONTEXT, len(text))))):
        at = m.start()
        if at >= hi:
            continue
        if m.lastgroup == "blank":
            count = [0] * len(KINDS)
            continue
        c = text[at]
        opens = OPENS.get(c)
        if opens is not None and count[opens] and _may_open(text, at):
            matched.add(at)
            if opens not in FLAT:
                count[opens] -= 1
        for k in CLOSES.get(c, ()):
            if _closes(text, at, k):
                count[k] = 1 if k in FLAT else min(AHEAD, count[k] + 1)
    return matched, count


def _begins_unit(text: str, at: int) -> int:
    """1 if the quotation opened at `at` begins a unit, so that a speaker may follow it."""
    if text[at] in _BRACKETS:
        return 0
    lead = text[max(0, at - 120) : at].rstrip()
    return int(not lead or lead[-1] in _TERM + _CLOSERS or bool(re.search(rf"\n{_W}*\n\s*$", text[max(0, at - 60) : at])))


def _moves(text: str, at: int, matched: set[int], state: list[int]) -> list[tuple[int, int]]:
    """(kind, symbol) of the mark at `at` in `state`."""
    c, out = text[at], []
    for k in CLOSES.get(c, ()):
        if _closes(text, at, k) and (state[k] or c != '"'):
            out.append((k, CLOSE))
    if at in matched and not (c == '"' and out):
        out.append((OPENS[c], OPEN1 if _begins_unit(text, at) else OPEN0))
    return out


def _number_at(text: str, line: int) -> int | None:
    m = _MARK.match(text, line)
    return int(m[2]) if m and m[2] else None


def _numbers(text: str, lo: int, hi: int, first: bool) -> tuple[bool, int]:
    """(whether [lo, hi) settles it, the number of the paragraph's last numbered line at hi; -1 for none)."""
    settled, last = False, -1
    if first and (n := _number_at(text, 0)) is not None:
        settled, last = True, n
    for m in _LINE.finditer(text, lo):
        if m.start() >= hi:
            break
        if m.lastgroup == "blank":
            settled, last = True, -1
        if (n := _number_at(text, m.end())) is not None:
            settled, last = True, n
    return settled, last


def emit(text: str, lo: int, hi: int, state: list[int], number: int, right: list[int], first: bool, broken: Callable[[int], object] | None = None) -> list[int]:
    """Ends of units that the transducer emits in [lo, hi), from its state at lo and the closings ahead at hi.

    `state` moves on; `broken` hears where it is reset.
    """
    matched, _ = _ahead(text, lo, hi, right)
    ends: list[int] = []
    items: set[int] = set()
    entry, done = number, lo
    if first and (n := _number_at(text, 0)) is not None:
        items.add(0)
        number = n

    def item(line: int, word: str) -> bool:
        return line in items or (line < lo and entry == int(word))

    def move(k: int, symbol: int) -> None:
        state[k] = _STEP[k][state[k]][symbol]

    def reset(at: int) -> None:
        state[:] = _zero()
        if broken:
            broken(at)

    for m in _EVENT.finditer(text, lo):
        at, kind = m.start(), m.lastgroup
        if at >= hi:
            break
        if at < done:
            continue
        if kind == "blank":
            ends.append(at)
            reset(at)
            number = -1
            if _MARK.match(text, m.end()):
                items.add(m.end())
                if (n := _number_at(text, m.end())) is not None:
                    number = n
        elif kind == "line":
            mark = _MARK.match(text, at + 1)
            if mark:
                n = int(mark[2]) if mark[2] else None
                if n is None or n == number + 1 and number >= 0 or not text[:at].strip() and first:
                    items.add(at + 1)
                    ends.append(at)
                    reset(at)
                if n is not None:
                    number = n
        elif kind == "thai":
            if not any(state):
                ends.append(at)
        elif kind == "quote":
            for k, symbol in _moves(text, at, matched, state):
                move(k, symbol)
        else:
            if at == lo and lo and text[lo - 1] in _TERM:  # the run began in the piece before
                continue
            stop, unit = m.end(), 0
            while stop < len(text) and (text[stop] in _CLOSERS or (text[stop] in "  " and text[stop + 1 : stop + 2] in ("»", "›"))):
                open_ = [k for k in CLOSES.get(text[stop], ()) if state[k] and _closes(text, stop, k)]
                if text[stop] in "“„\"" and not open_:
                    break
                for k, symbol in _moves(text, stop, matched, state):
                    if symbol == CLOSE and state[k]:
                        unit = STATES[state[k]][-1]  # of the outermost one closed
                    move(k, symbol)
                stop += 1
            done = stop
            if m[0] == "." and stop == m.end() and text[stop : stop + 1].isdigit():
                continue
            if _ends(text, at, stop, bool(unit), item) and not any(state):
                ends.append(stop)
    return ends


def spans_of(text: str, ends: list[int]) -> list[tuple[int, int]]:
    out, begin = [], 0
    for end in [*sorted(set(ends)), len(text)]:
        a, b = begin, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        begin = max(begin, end)
    return out


def units(text: str | None, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, end) of every unit; a text longer than `piece` by pieces and scans, as the distributed query does."""
    if not text:
        return []
    if len(text) <= piece:
        return spans_of(text, emit(text, 0, len(text), _zero(), -1, _zero(), True))
    cuts = [(at, min(at + piece, len(text))) for at in range(0, len(text), piece)]
    right = prefix_scan([back_function(text, a, b) for a, b in reversed(cuts)])[::-1]
    numbers, last = [], -1
    for a, b in cuts:
        numbers.append(last)
        settled, n = _numbers(text, a, b, a == 0)
        last = n if settled else last
    entry = prefix_scan([function(text, a, b, n, r, a == 0) for (a, b), n, r in zip(cuts, numbers, right, strict=True)])
    ends = [e for (a, b), n, r, s in zip(cuts, numbers, right, entry, strict=True) for e in emit(text, a, b, list(s), n, r, a == 0)]
    return spans_of(text, ends)


def back_function(text: str, lo: int, hi: int) -> np.ndarray:
    """A piece read from the right: per kind, the closings ahead at its beginning for each number of them ahead at its end."""
    columns = [_ahead(text, lo, hi, [n] * len(KINDS))[1] for n in range(AHEAD + 1)]
    return np.array(columns, np.int32).T.copy()


def function(text: str, lo: int, hi: int, number: int, right: list[int], first: bool) -> np.ndarray:
    """A piece read from the left: per kind, the exit state for each entry state."""
    out = np.tile(np.arange(len(STATES), dtype=np.int32), (len(KINDS), 1))
    matched, _ = _ahead(text, lo, hi, right)
    straight = OPENS['"']
    moves: list[tuple[int, int, int]] = []  # (position, kind, symbol)
    resets: list[int] = []
    emit(text, lo, hi, _zero(), number, right, first, resets.append)
    for m in _PARTS.finditer(text, lo):
        at = m.start()
        if at >= hi:
            break
        if m.lastgroup == "quote":
            moves += [(at, k, CLOSE) for k in CLOSES.get(text[at], ()) if _closes(text, at, k)]
            if at in matched:
                moves.append((at, OPENS[text[at]], OPEN1 if _begins_unit(text, at) else OPEN0))
    marks = sorted([*((at, 1, k, x) for at, k, x in moves), *((at, 0, 0, RESET) for at in resets)], key=lambda t: t[:2])
    for i, (at, _, k, symbol) in enumerate(marks):
        if symbol == RESET:
            out[:] = 0
        elif k == straight and text[at] == '"':
            # one mark closes an open quotation, else opens one
            if symbol == CLOSE or not (i and marks[i - 1][0] == at and marks[i - 1][2] == straight):
                opening = next((t[3] for t in marks[i : i + 2] if t[0] == at and t[2] == straight and t[3] != CLOSE), None)
                shut = SINGLE[out[k], CLOSE] if symbol == CLOSE else out[k]
                out[k] = np.where(out[k] > 0, shut, out[k] if opening is None else SINGLE[out[k], opening])
        else:
            out[k] = _NEXT[k][out[k], symbol]
    return out


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """First one piece, then the next, kind by kind; associative, so pieces can be scanned in blocks."""
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(functions: list[np.ndarray]) -> list[list[int]]:
    """The state that each piece is entered in, from the closed state before the first."""
    state, out = np.zeros((len(KINDS), 1), np.int32), []
    for f in functions:
        out.append(state[:, 0].tolist())
        state = np.take_along_axis(f, state, axis=1)
    return out


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, starts, stops = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for a, b in units(text, 1 << 62):
                keys.append(key)
                starts.append(a)
                stops.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["doc_id", "start_char", "end_char"])


_PIECE_ROW = "uid long, doc_id long, piece int, part string, base int, length int"


def _pieces(piece: int):
    """A long document's pieces, with context on either side."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for group in range(0, -(-len(text) // piece), 64):
                    rows = [(uid, key, n, text[max(0, n * piece - CONTEXT) : (n + 1) * piece + CONTEXT], max(0, n * piece - CONTEXT), len(text)) for n in range(group, min(group + 64, -(-len(text) // piece)))]
                    uid_, key_, number, part, base, length = zip(*rows, strict=True)
                    columns = [pa.array(uid_, pa.int64()), pa.array(key_, pa.int64()), pa.array(number, pa.int32()), pa.array(part, pa.string()), pa.array(base, pa.int32()), pa.array(length, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "piece", "part", "base", "length"])

    return work


def _within(piece: int, number: int, part: str, base: int) -> tuple[int, int]:
    """[lo, hi) of a piece in its part."""
    lo = number * piece - base
    return lo, min(lo + piece, len(part))


def _from_right(piece: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            functions, numbers = [], []
            for n, part, base in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                lo, hi = _within(piece, n, part, base)
                functions.append(back_function(part, lo, hi).ravel())
                settled, last = _numbers(part, lo, hi, n == 0)
                numbers.append(last if settled else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(functions, pa.list_(pa.int32())), pa.array(numbers, pa.int32())], names=["uid", "piece", "function", "number"])

    return work


def _from_left(piece: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            functions = []
            for n, part, base, number, right in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 6, 7)), strict=True):
                functions.append(function(part, *_within(piece, n, part, base), number, right, n == 0).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(functions, pa.list_(pa.int32()))], names=["uid", "piece", "function"])

    return work


def _boundaries(piece: int):
    """(at, stop, start): boundaries of a piece, where the unit before ends and where the next begins; the document's own two as well."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, key, n, part, base, length, number, right, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lo, hi = _within(piece, n, part, base)
                ends = set(emit(part, lo, hi, entry, number, right, n == 0))
                for e in sorted(ends | ({0} if n == 0 else set()) | ({length - base} if (n + 1) * piece >= length else set())):
                    a = b = e
                    while a and part[a - 1].isspace():
                        a -= 1
                    while b < len(part) and part[b].isspace():
                        b += 1
                    rows.append((uid, key, base + e, base + a, base + b))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["uid", "doc_id", "at", "stop", "start"])

    return work


def _block(width: int):
    """Of each piece of a block the function of the pieces before it in the block; of the block (piece null) that of all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = np.tile(np.arange(width, dtype=np.int32), (len(KINDS), 1))
        key, running = None, same

        def emitted(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())), strict=True)], names=["uid", "block", "piece", "function"])

        for batch in batches:
            rows = []
            for uid, block, piece, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (uid, block) != key:
                    if key is not None:
                        rows.append((*key, None, running.ravel()))
                    key, running = (uid, block), same
                rows.append((uid, block, piece, running.ravel()))
                running = compose(running, np.array(f, np.int32).reshape(len(KINDS), width))
            yield emitted(rows)
        if key is not None:
            yield emitted([(*key, None, running.ravel())])

    return work


def _over_blocks(width: int):
    """The state in which each block of a document is entered."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, np.zeros((len(KINDS), 1), np.int32)
        for batch in batches:
            rows = []
            for uid, block, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uid != key:
                    key, state = uid, np.zeros((len(KINDS), 1), np.int32)
                rows.append((uid, block, state[:, 0].tolist()))
                state = np.take_along_axis(np.array(f, np.int32).reshape(len(KINDS), width), state, axis=1)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.int32())), strict=True)], names=["uid", "block", "state"])

    return work


def scanned(functions: DataFrame, width: int, backward: bool) -> DataFrame:
    """uid, piece, state: an exclusive scan of the pieces' functions, in blocks of SPAN pieces and over the blocks.

    A task holds one function at a time, however long the document.
    """
    sign = -1 if backward else 1
    keyed = functions.select("uid", F.floor(F.col("piece") / SPAN).cast("int").alias("block"), "piece", "function")
    inner = keyed.repartition("uid", "block").sortWithinPartitions("uid", "block", F.col("piece") * sign).mapInArrow(_block(width), "uid long, block int, piece int, function array<int>")
    inner = stored(inner)
    totals = inner.filter("piece is null").select("uid", "block", "function")
    outer = totals.repartition("uid").sortWithinPartitions("uid", F.col("block") * sign).mapInArrow(_over_blocks(width), "uid long, block int, state array<int>")
    return inner.filter("piece is not null").join(outer, ["uid", "block"]).select("uid", "piece", F.expr(f"transform(state, (s, k) -> function[k * {width} + s])").alias("state"))


def _long_units(long: DataFrame, piece: int) -> DataFrame:
    pieces = stored(long.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(_pieces(piece), _PIECE_ROW))
    rights = stored(pieces.mapInArrow(_from_right(piece), "uid long, piece int, function array<int>, number int"))
    before = Window.partitionBy("uid").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    numbers = rights.select("uid", "piece", F.coalesce(F.last("number", ignorenulls=True).over(before), F.lit(-1)).alias("number"))
    known = pieces.join(numbers, ["uid", "piece"]).join(scanned(rights.select("uid", "piece", "function"), AHEAD + 1, True).withColumnRenamed("state", "right"), ["uid", "piece"])
    known = known.select("uid", "doc_id", "piece", "part", "base", "length", "number", "right")
    entries = scanned(known.mapInArrow(_from_left(piece), "uid long, piece int, function array<int>"), len(STATES), False)
    marks = known.join(entries, ["uid", "piece"]).select(*known.columns, "state").mapInArrow(_boundaries(piece), "uid long, doc_id long, at int, stop int, start int")
    marks = marks.groupBy("uid", "doc_id", "at").agg(F.min("stop").alias("stop"), F.max("start").alias("start"))
    order = Window.partitionBy("uid").orderBy("at")
    spans = marks.select("doc_id", F.lag("start").over(order).alias("start_char"), F.col("stop").alias("end_char"))
    return spans.filter("start_char < end_char")


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """doc_id, start_char, end_char of every sentence, heading and list item.

    Offsets are code points. Null, empty and blank texts have no unit; a text
    without any boundary is one unit; a null key is kept; repeated rows repeat
    their units, so keys should be unique. Only `key` and `text` are read.
    Documents longer than `piece` go through pieces and scans, the others through
    the same transducer in one go. Quotations may be of any length; more than DEPTH
    open ones of one kind count as DEPTH.
    """
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull() & (F.col("text") != ""))
    short = rows.filter(F.length("text") <= piece).mapInArrow(_short, "doc_id long, start_char int, end_char int")
    return short.unionByName(_long_units(rows.filter(F.length("text") > piece), piece))


def p9_found(documents: DataFrame) -> DataFrame:
    """doc_id, start_char, end_char of the units of documents."""
    return sentence_units(documents)
