"""Sentence boundaries across languages and scripts.

The rules are compiled into two finite transducers in a row. The first reads letters:
it follows words, numbers and addresses and tells at every full stop what stands before
it. The second reads character classes with these stops and emits the boundaries, some
of them a word later. Long documents are cut into chunks; each chunk is first read as a
function from every state to the state it leads to, these functions are composed by a
parallel prefix scan, and only then, with every chunk's first state known, the outputs
are emitted. All chunks of an Arrow batch advance together in numpy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Character classes. A single full stop is a POINT, or GLUED if a capital follows a small
# letter and it; what stands before it is added to these two by the first transducer.
(NEWLINE, SPACE, UPPER, LOWER, DIGIT, LETTER, HAN, PARTICLE, THAI, MARK, STOP, WIDE, DOTS,
 OPEN, CLOSE, BRACKET, LOW, DOUBLE, STRAIGHT, LEFT, RIGHT, DASH, SYMBOL, SIGN, MONTH_END, FORM_END) = range(26)

# What stands before a full stop, as read by the first transducer: a word, or one whose stop
# is part of it always, before a number, before a capital, before either, before a single
# capital with a stop of its own, before a legal form, or before more Arabic; a number of one
# or two digits, one that begins a block; and an address.
(PLAIN, ALWAYS, NUMBERED, NAMED, EITHER, HALF, HALF_NUMBERED, COMPANY, ARABIC, SHORT_NUMBER, FIRST_NUMBER, ADDRESS) = range(12)
N_BEFORE = 12
POINT, GLUED = 26, 26 + N_BEFORE
N_CLASSES = 26 + 2 * N_BEFORE

# Signs of each class.
_SIGNS = {
    POINT: ".।॥۔።՝܀", MARK: "!?؟‼⁇⁈⁉", STOP: "。．｡", WIDE: "！？", DOTS: "…", OPEN: "([{“‘「『（【《〈〔¡¿",
    CLOSE: "”’」』》〉", BRACKET: ")]}）】〕", LOW: "„‚", DOUBLE: "“", STRAIGHT: '"', LEFT: "«", RIGHT: "»", DASH: "-–—―‒",
}


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point of the basic plane; others count as symbols or letters."""
    table = np.full(0x10000, SIGN, np.uint8)
    for code in range(0x10000):
        if 0x3400 <= code < 0xA000 or 0x3040 <= code < 0x3100 or 0xF900 <= code < 0xFB00:
            table[code] = HAN
            continue
        if 0xAC00 <= code < 0xD7B0:
            table[code] = LETTER
            continue
        c = chr(code)
        kind = unicodedata.category(c)
        if 0xE00 <= code < 0xE80 and kind[0] in "LM":
            table[code] = THAI
        elif c in "\n\x0b\x0c\x85  ":
            table[code] = NEWLINE if c in "\n  " else SPACE
        elif c.isspace():
            table[code] = SPACE
        elif kind in ("Lu", "Lt"):
            table[code] = UPPER
        elif kind == "Ll":
            table[code] = LOWER
        elif kind[0] in "LM":
            table[code] = LETTER
        elif kind[0] == "N":
            table[code] = DIGIT
        elif kind in ("So", "Sc"):
            table[code] = SYMBOL
    for kind, signs in _SIGNS.items():
        for c in signs:
            table[ord(c)] = kind
    table[ord("と")] = PARTICLE
    return table


# A state: (kind, closing quote seen, blank seen, line break seen, dash pending, open quote).
# Kinds: block start, mid-sentence, mid-sentence after a Thai letter, after each end mark, and
# waiting for what a word turns out to be: a letter with a stop, a month, a legal form.
(_BEGIN, _MID, _MID_THAI, _AFTER_MARK, _AFTER_STOP, _AFTER_WIDE, _AFTER_DOTS, _WAIT_HALF, _WAIT_MONTH, _WAIT_FORM) = range(10)
_AFTER_POINT, _AFTER_GLUED = 10, 10 + N_BEFORE
_END = {MARK: _AFTER_MARK, STOP: _AFTER_STOP, WIDE: _AFTER_WIDE, DOTS: _AFTER_DOTS}
_END |= {POINT + k: _AFTER_POINT + k for k in range(N_BEFORE)} | {GLUED + k: _AFTER_GLUED + k for k in range(N_BEFORE)}
#: Emissions: nothing, a sentence starts here, it may start here, it started at the last such place.
NOTHING, STARTS, MAY_START, STARTED = range(4)

State = tuple[int, bool, bool, bool, bool, int]
_START: State = (_BEGIN, False, False, False, False, 0)
_WORD = (UPPER, LOWER, LETTER, DIGIT, MONTH_END, FORM_END)


def _quote_role(sign: int, inside: int) -> tuple[str, int]:
    """Whether a quotation mark opens or closes, given the one that is open."""
    if sign == LEFT:
        return ("close", 0) if inside == RIGHT else ("open", LEFT)
    if sign == RIGHT:
        return ("close", 0) if inside == LEFT else ("open", RIGHT)
    if sign == LOW:
        return "open", LOW
    if sign == DOUBLE:
        return ("close", 0) if inside == LOW else ("open", inside)
    if sign == STRAIGHT:
        return ("close", 0) if inside == STRAIGHT else ("open", STRAIGHT)
    if sign == CLOSE:
        return "close", 0 if inside == LOW else inside
    return "open", inside


def _boundary(kind: int, quoted: bool, blank: bool, dash: bool, sign: int) -> bool:
    """Whether a sentence that seemed to end before ``sign`` really did."""
    apart = blank or dash
    cjk = kind in (_AFTER_STOP, _AFTER_WIDE)
    loud = kind in (_AFTER_MARK, _AFTER_WIDE)
    if kind == _AFTER_DOTS:
        return sign == UPPER and apart
    if sign == UPPER:
        return apart or cjk or loud or quoted or kind >= _AFTER_GLUED
    if sign == LOWER:
        return cjk and not (quoted and loud) and not dash
    if sign == DIGIT:
        return apart or cjk
    if sign == THAI:
        return (apart or loud) and not (quoted and loud)
    if sign in (LETTER, HAN):
        return not (quoted and loud)
    if sign == PARTICLE:
        return not quoted
    if sign == SYMBOL:
        return apart or cjk
    return False


def _belongs(before: int, sign: int, blank: bool) -> int | None:
    """What a stop after ``before`` is once ``sign`` follows it: part of a word (-1), an end (None), or to be seen (a waiting kind)."""
    if sign not in (UPPER, DIGIT, LETTER, HAN, THAI, OPEN):
        return None
    if before == ALWAYS or (before == FIRST_NUMBER and blank) or (before == ARABIC and sign == LETTER):
        return -1
    if sign == DIGIT:
        return -1 if before in (NUMBERED, EITHER, HALF_NUMBERED) or (before == SHORT_NUMBER and blank) else None
    if sign == UPPER:
        if before in (NAMED, EITHER) or (before == ADDRESS and not blank):
            return -1
        if before == SHORT_NUMBER and blank:
            return _WAIT_MONTH
        return {HALF: _WAIT_HALF, HALF_NUMBERED: _WAIT_HALF, COMPANY: _WAIT_FORM}.get(before)
    return None


def transition(state: State, sign: int) -> tuple[State, int]:
    """The rules: one step of the transducer."""
    kind, quoted, blank, line, dash, inside = state
    if kind in (_WAIT_HALF, _WAIT_MONTH, _WAIT_FORM):
        # A sentence began with the word at hand, unless the word is what was waited for.
        middle = (_MID, False, False, False, False, inside)
        if (POINT <= sign if kind == _WAIT_HALF else sign == (MONTH_END if kind == _WAIT_MONTH else FORM_END)):
            return transition(middle, sign)
        if kind != _WAIT_HALF and sign in (*_WORD, SYMBOL):
            return state, NOTHING
        return transition(middle, sign)[0], STARTED
    if sign == NEWLINE:
        if kind == _BEGIN or line:
            return _START, NOTHING
        return (kind, quoted, True, True, dash, inside), NOTHING
    if sign == SPACE:
        return (kind, quoted, kind != _BEGIN, line, dash, inside), NOTHING
    if kind >= _AFTER_POINT and not quoted and not dash:
        meant = _belongs((kind - _AFTER_POINT) % N_BEFORE, sign, blank)
        if meant == -1:
            kind = _MID
        elif meant is not None and blank:
            return (meant, False, False, False, False, inside), MAY_START
        elif meant is not None:
            kind = _MID if kind < _AFTER_GLUED else kind
    role = ""
    if sign in (LEFT, RIGHT, LOW, DOUBLE, STRAIGHT, OPEN, CLOSE):
        role, now = _quote_role(sign, inside)
    else:
        now = inside
    out = NOTHING
    if kind == _BEGIN:
        out = STARTS
    elif kind in (_MID, _MID_THAI):
        if kind == _MID_THAI and blank and sign == THAI:
            out = STARTS
    else:
        if sign == STRAIGHT and inside != STRAIGHT and not blank:
            role, now = "close", inside
        if sign in _END and not (sign == STOP and blank):
            new = _END[sign] if not ((sign >= POINT or sign == DOTS) and kind in (_AFTER_MARK, _AFTER_WIDE)) else kind
            return (new, quoted, False, False, False, now), NOTHING
        if role == "close":
            return (kind, True, False, False, False, now), NOTHING
        if sign == BRACKET:
            # What stood before the stop counts only directly after it.
            end = _AFTER_POINT if _AFTER_POINT <= kind < _AFTER_GLUED else _AFTER_GLUED if kind >= _AFTER_GLUED else kind
            return (end, quoted, False, False, False, now), NOTHING
        if sign == DASH and (blank or kind in (_AFTER_STOP, _AFTER_WIDE)):
            return (kind, quoted, False, False, True, now), MAY_START
        if role == "open":
            cjk = kind in (_AFTER_STOP, _AFTER_WIDE)
            if kind != _AFTER_DOTS and (blank or dash or cjk or kind == _AFTER_MARK):
                out = STARTED if dash else STARTS
        elif _boundary(kind, quoted, blank, dash, sign):
            out = STARTED if dash else STARTS
    follow = _END.get(sign, _MID_THAI if sign == THAI else _MID)
    return (follow, False, False, False, False, now), out


@lru_cache(maxsize=1)
def compiled() -> tuple[np.ndarray, np.ndarray]:
    """Flat next-state and emission tables over all states that can be reached; state 0 starts a block."""
    return _tables(_START, lambda state: [transition(state, sign) for sign in range(N_CLASSES)], N_CLASSES)


# Abbreviations whose stop never ends a sentence, by language.
_ALWAYS = (
    "Mr Mrs Ms Messrs Dr dr Prof prof St Sr Jr Rev Gen Capt Col Sgt Lt Hon Gov Sen Rep vs cf approx Approx "  # English
    "Jan Feb Apr Aug Sept Oct Nov Dec "
    "Éts Ets Mme Mlle MM Sté Cie "  # French
    "Fr Hr Hrn Fa Frl Dipl Ing vgl Vgl "  # German
    "Sra Srta Sres Ud Uds sr sra sig Sig sigg dott Dott avv Avv dhr Dhr mevr Mevr drs "  # Spanish, Italian, Dutch
    "mr inž ing dipl akad ul Ul čl st br str tzv npr Npr sv Sv g-đa gđa gđe gđica "  # Serbian, Latin
    "Др др Проф проф инж дипл акад ул Ул чл ст бр стр тзв нпр Нпр св Св гђа "  # Serbian, Cyrillic
    "См см им рис Рис гл тов просп пер наб "  # Russian
    "Δρ δρ Κα κα σελ Βλ βλ Αγ αγ "  # Greek
    "डॉ पृ प्रो श्री सं रु कु "  # Hindi
    "ดร รศ ผศ ศ นพ พญ น พ.ศ ค.ศ "  # Thai
    "ص د أ م ج"  # Arabic
).split()
#: Abbreviations only before a number.
_BEFORE_NUMBER = (
    "No no Nos nos Nr nr Abs sec Sec fig Fig figs art Art ch Ch p pp vol Vol par Bd Kap S Str Tab Abb ca Ca "
    "sl god čl st br п д г т л с р. гл стр чл ст бр αρ Αρ σελ ص n num N nº"
).split()
#: Abbreviations only before a name, and legal forms after "Co.".
_BEFORE_NAME = "g г κ Κ kap кап Gos Hl hl".split()
#: First halves of German abbreviations such as "z. B.".
_FIRST_HALF = "z u i s o d".split()
_LEGAL = ("KG", "Inc", "Ltd", "OHG", "LLC")
#: German names of months and the like, before which a number with a stop is a date.
_MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert".split()


def _as_stored(words: list[str] | tuple[str, ...]) -> list[str]:
    """The words, and what they look like where UTF-8 was read as a Western single-byte text."""
    return [*words, *(w.encode().decode("cp1252", "ignore") for w in words if not w.isascii())]


# Letters as the first transducer sees them: those of the lists one by one, others by kind.
(_NEW, _BLANK, _UP, _SMALL, _OTHER, _ARAB, _FIGURE, _COMBINING, _FULL, _HYPHEN, _QUOTE, _SLASH, _UNDER, _LISTED, _ELSE) = range(15)


@dataclass(frozen=True)
class _Words:
    """Trie of the lists; ``says`` has what a stop after a node's word is, ``done`` the words that end at a node."""

    letters: dict[str, int]
    kids: list[dict[str, int]]
    says: list[set[str]]
    done: list[int]


@lru_cache(maxsize=1)
def _words() -> _Words:
    kids: list[dict[str, int]] = [{}]
    says: list[set[str]] = [set()]
    done = [0]
    lists = (
        ("always", _as_stored(_ALWAYS)), ("number", _BEFORE_NUMBER), ("name", _BEFORE_NAME), ("half", _FIRST_HALF), ("company", ("Co",)),
        ("www", ("www",)), (MONTH_END, _as_stored(_MONTHS)), (FORM_END, _LEGAL),
    )
    for what, words in lists:
        for word in words:
            node = 0
            for c in word:
                if c not in kids[node]:
                    kids[node][c] = len(kids)
                    kids.append({})
                    says.append(set())
                    done.append(0)
                node = kids[node][c]
            if isinstance(what, str):
                says[node].add(what)
            else:
                done[node] = what
    letters = {c: 15 + i for i, c in enumerate(sorted({c for k in kids for c in k}))}
    return _Words(letters, kids, says, done)


def _kind(c: str) -> int:
    """The kind of letter or sign a character is to the first transducer."""
    if c in "\n\u2028\u2029":
        return _NEW
    if c.isspace():
        return _BLANK
    kind = unicodedata.category(c)
    if kind[0] == "M":
        return _COMBINING
    if kind in ("Lu", "Lt"):
        return _UP
    if kind == "Ll":
        return _SMALL
    if kind[0] == "L":
        return _ARAB if "\u0600" <= c < "\u0700" else _OTHER
    if kind[0] == "N":
        return _FIGURE
    special = {".": _FULL, "-": _HYPHEN, "'": _QUOTE, "’": _QUOTE, "/": _SLASH, "@": _SLASH, "_": _UNDER}
    return special.get(c, _LISTED if c in "!?)”»“\",;:%" else _ELSE)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """The symbol of every code point of the basic plane for the first transducer."""
    table = np.array([_kind(chr(c)) if not 0xD800 <= c < 0xE000 else _ELSE for c in range(0x10000)], np.uint8)
    for c, symbol in _words().letters.items():
        table[ord(c)] = symbol
    return table


# States of the first transducer. Between words: ("out", whether the block is fresh, a line
# break is pending, digits may begin). In a number: ("number", digits, whether it begins the
# block). In a word: ("word", node from its beginning, node from its last part, whether a stop
# is inside, the only letter of the last part, whether a part just ended). In an address: ("address",).
_DEAD = -1


def _read(state: tuple, symbol: str | int) -> tuple[tuple, int]:
    """One step of the first transducer: a listed letter or a kind; returns the state and what is told here."""
    words = _words()
    kind = _kind(symbol) if isinstance(symbol, str) else symbol
    told = 0
    if kind == _NEW:
        fresh = state[0] == "out" and (state[1] or state[2])
        return ("out", fresh, True, True), told
    if kind == _BLANK:
        return ("out", state[1], state[2], True) if state[0] == "out" else ("out", False, False, True), told
    if state[0] == "address":
        return state, ADDRESS if kind == _FULL else told
    if kind == _SLASH:
        return ("address",), told
    if kind == _FULL:
        told = _before(state)
        if state[0] == "word" and state[2] != _DEAD and "www" in words.says[state[2]]:
            return ("address",), told
    letter = kind in (_UP, _SMALL, _OTHER, _ARAB)
    listed = state[0] == "word" and kind == _ELSE and any(n != _DEAD and symbol in words.kids[n] for n in state[1:3])
    if state[0] == "word" and (letter or listed or kind in (_FIGURE, _COMBINING)):
        _, whole, last, stop, one, ended = state
        step = lambda node: words.kids[node].get(symbol, _DEAD) if node != _DEAD and isinstance(symbol, str) else _DEAD
        whole, last = step(whole), step(last)
        told = words.done[last] if last != _DEAD else 0
        return ("word", whole, last, stop, kind if ended and letter else 0, False), told
    if state[0] == "word" and not state[5] and kind in (_FULL, _QUOTE, _HYPHEN):
        _, whole, last, stop, one, _ = state
        sign = symbol if isinstance(symbol, str) else {_FULL: ".", _QUOTE: "'"}.get(kind, "-")
        step = lambda node: words.kids[node].get(sign, _DEAD) if node != _DEAD else _DEAD
        if kind == _HYPHEN:
            return ("word", step(whole), step(last), stop, 0, True), told
        return ("word", step(whole), 0, stop or kind == _FULL, 0, True), told
    if letter:
        node = words.kids[0].get(symbol, _DEAD) if isinstance(symbol, str) else _DEAD
        return ("word", node, node, False, kind, False), told
    if kind == _FIGURE:
        if state[0] == "number":
            return ("number", min(3, state[1] + 1), state[2]), told
        if state[0] == "out" and state[3]:
            return ("number", 1, state[1] or False), told
        return ("out", False, False, False), told
    fresh = state[0] == "out" and state[1] and kind in (_ELSE, _HYPHEN, _COMBINING)
    return ("out", fresh, False, kind not in (_FULL, _UNDER) and symbol != ","), told


def _before(state: tuple) -> int:
    """What stands before a full stop met in ``state``."""
    if state[0] == "number":
        return FIRST_NUMBER if state[2] else SHORT_NUMBER if state[1] < 3 else PLAIN
    if state[0] != "word" or state[5]:
        return PLAIN
    _, whole, last, stop, one, _ = state
    says = _words().says
    own, part = (says[whole] if whole != _DEAD else set()), (says[last] if last != _DEAD else set())
    if "always" in own | part:
        return ALWAYS
    named = one == _UP or "name" in part
    if "half" in own:
        return HALF_NUMBERED if "number" in part else HALF
    if named or "number" in part:
        return EITHER if named and "number" in part else NAMED if named else NUMBERED
    return COMPANY if "company" in part else ARABIC if one == _ARAB else PLAIN


def _tables(first, steps, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Next-state and emission tables over all states that can be reached from ``first``, which is state 0."""
    number, queue, rows = {first: 0}, [first], []
    for state in queue:
        row = []
        for after, out in steps(state):
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            row.append((number[after], out))
        rows.append(row)
    table = np.array(rows)
    assert table.shape[1] == n_symbols
    return np.ascontiguousarray(table[:, :, 0].astype(np.int16)), np.ascontiguousarray(table[:, :, 1].astype(np.uint8))


@lru_cache(maxsize=1)
def compiled_words() -> tuple[np.ndarray, np.ndarray]:
    """Tables of the first transducer."""
    symbols = [*range(15), *_words().letters]
    return _tables(("out", True, False, True), lambda state: [_read(state, x) for x in symbols], len(symbols))


def classify(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every code point of ``text``, its symbol for the first transducer, and whether it is blank."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = class_table()
    low = np.minimum(codes, 0xFFFF)
    signs, symbols = table[low], letter_table()[low]
    high = codes > 0xFFFF
    if high.any():
        signs, symbols = signs.copy(), symbols.copy()
        far = codes[high]
        signs[high] = np.where((far >= 0x20000) & (far < 0x32000), HAN, np.where(far < 0x1D400, LETTER, SYMBOL))
        symbols[high] = np.where((far < 0x1D400) | ((far >= 0x20000) & (far < 0x32000)), _OTHER, _ELSE)
    blank = signs <= SPACE
    if not len(signs):
        return signs, symbols, blank
    prev = np.append(np.uint8(SPACE), signs[:-1])
    after = np.append(signs[1:], np.uint8(SPACE))
    stops = codes == 0x2E
    runs = stops & (np.append(False, stops[:-1]) | np.append(stops[1:], False))
    signs[runs] = DOTS
    # A Greek question mark, and a wide stop within a number.
    greek = (codes == 0x3B) & (np.append(0, codes[:-1]) >= 0x370) & (np.append(0, codes[:-1]) < 0x400)
    greek |= (codes == 0x3B) & (np.append(0, codes[:-1]) >= 0x1F00) & (np.append(0, codes[:-1]) < 0x2000)
    greek |= codes == 0x37E
    signs[greek] = MARK
    signs[(codes == 0xFF0E) & (prev == DIGIT) & (after == DIGIT)] = SIGN
    single = stops & ~runs
    signs[single & ((after == LOWER) | (after == DIGIT) | (after == SIGN) | (after == DASH))] = SIGN
    signs[single & (after == UPPER) & ((prev == LOWER) | (prev == DIGIT))] = GLUED
    return signs, symbols, blank


def run_transducer(tables: tuple[np.ndarray, np.ndarray], signs: np.ndarray, first: np.ndarray, chunk: int) -> np.ndarray:
    """Emissions of documents laid end to end; ``first`` has where each begins, and the end.

    Every document is cut into chunks of at most ``chunk`` characters. The result does
    not depend on ``chunk``.
    """
    table, emit = tables
    width = table.shape[1]
    flat_next, flat_emit = table.ravel().astype(np.int32), emit.ravel()
    lengths = np.diff(first)
    per_doc = -(-lengths // chunk)
    total = int(per_doc.sum())
    out = np.zeros(int(first[-1]), np.uint8)
    if not total:
        return out
    doc = np.repeat(np.arange(len(lengths)), per_doc)
    ordinal = np.arange(total) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = first[doc] + ordinal * chunk
    size = np.minimum(first[doc + 1], start + chunk) - start
    entering = np.zeros(total, np.int32)
    later = np.flatnonzero(ordinal > 0)
    if len(later):
        # Chunks that are followed by another one, as functions on states.
        needed = np.flatnonzero(np.append(ordinal[1:] > 0, False))
        maps = _functions(signs, start[needed], size[needed], flat_next, len(table), width)
        # Inclusive prefix scan by doubling: after it, each map leads from its document's start.
        rank = ordinal[needed]
        step = 1
        while step <= rank.max(initial=0):
            reach = np.flatnonzero(rank >= step)
            maps[reach] = np.take_along_axis(maps[reach], maps[reach - step], axis=1)
            step *= 2
        entering[needed + 1] = maps[:, 0]
    order = np.argsort(-size, kind="stable")
    at, long, state = start[order], size[order], entering[order]
    for j in range(int(long[0])):
        active = int(np.searchsorted(-long, -j, side="left"))
        here = at[:active] + j
        key = state[:active] * width + signs[here]
        out[here] = flat_emit[key]
        state[:active] = flat_next[key]
    return out


def _functions(signs: np.ndarray, start: np.ndarray, size: np.ndarray, flat_next: np.ndarray, n_states: int, n_symbols: int) -> np.ndarray:
    """For every chunk the state reached from each state.

    Chunks mostly forget where they came from (a blank line suffices), so states that
    have met are carried on as one.
    """
    maps = np.tile(np.arange(n_states, dtype=np.int32), (len(start), 1))
    live = maps.copy()
    width = n_states
    for j in range(int(size.max(initial=0))):
        active = np.flatnonzero(size > j)
        live[active] = flat_next[live[active] * n_symbols + signs[start[active] + j][:, None]]
        if width > 1 and (j in (1, 3, 7, 15, 31, 63) or j % 128 == 127):
            # Renumber: each chunk keeps its distinct states only, padded to the widest.
            order = np.argsort(live, axis=1, kind="stable")
            ranked = np.take_along_axis(live, order, axis=1)
            fresh = np.concatenate([np.zeros((len(live), 1), bool), ranked[:, 1:] != ranked[:, :-1]], axis=1)
            group = np.cumsum(fresh, axis=1)
            slot = np.empty_like(group)
            np.put_along_axis(slot, order, group, axis=1)
            new_width = int(group.max()) + 1
            if new_width < width:
                shrunk = np.repeat(ranked[:, :1], new_width, axis=1)
                np.put_along_axis(shrunk, group, ranked, axis=1)
                maps = np.take_along_axis(slot, maps, axis=1).astype(np.int32)
                live, width = shrunk, new_width
    return np.take_along_axis(live, maps, axis=1)


def with_words(signs: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Classes with what the first transducer told about stops and about ends of months and legal forms."""
    stop = (signs == POINT) | (signs == GLUED)
    word = ~stop & (told >= MONTH_END) & ((signs == LOWER) | (signs == UPPER) | (signs == LETTER))
    return np.where(stop, signs + np.where(told < N_BEFORE, told, 0), np.where(word, told, signs)).astype(np.uint8)


def sentence_spans(texts: list[str], chunk: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and end of every sentence, as code-point offsets."""
    parts = [classify(t) for t in texts]
    lengths = np.array([len(p[0]) for p in parts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    if not first[-1]:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    signs, symbols, blank = (np.concatenate([p[k] for p in parts]) for k in range(3))
    signs = with_words(signs, run_transducer(compiled_words(), symbols, first, chunk))
    out = run_transducer(compiled(), signs, first, chunk)
    places = np.arange(len(signs))
    maybe = np.maximum.accumulate(np.where(out == MAY_START, places, -1))
    starts = np.unique(np.concatenate([places[out == STARTS], maybe[out == STARTED]]))
    solid = np.maximum.accumulate(np.where(blank, -1, places))
    limit = np.append(starts[1:], len(signs))
    doc = np.searchsorted(first, starts, side="right") - 1
    ends = solid[np.minimum(limit, first[doc + 1]) - 1] + 1
    return doc, starts - first[doc], ends - first[doc]


def split_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = 4096) -> DataFrame:
    """Sentences of every document: ``doc_id, start_char, end_char`` (code points, end exclusive).

    Blank lines always end a sentence, single line breaks never do. Together the
    sentences cover all text but white space. Null, empty and blank texts have none;
    very long texts are read whole, chunk by chunk; repeated documents give repeated
    rows; an empty table gives none. Other columns are ignored whatever their names.

    Scale: one narrow pass over the two columns it needs, without a shuffle.
    """
    pairs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    key = pairs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            # Bounded work at a time: as many documents as make some millions of characters.
            sizes = np.cumsum(column.nbytes // max(1, len(column)) * np.ones(len(column)))
            cuts = np.searchsorted(sizes, np.arange(1, sizes[-1] // 8e6 + 1) * 8e6) if len(sizes) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(column)], strict=True):
                if hi > lo:
                    doc, start, end = sentence_spans(column.slice(lo, hi - lo).to_pylist(), chunk)
                    yield pa.record_batch(
                        [ids.take(pa.array(doc + lo)), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                        names=["doc_id", "start_char", "end_char"],
                    )

    return pairs.mapInArrow(read, f"doc_id {key}, start_char bigint, end_char bigint")


def p9_found(docs: DataFrame) -> DataFrame:
    return split_sentences(docs)
