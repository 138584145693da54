"""A trie of strings searched with a Levenshtein automaton.

The automaton is universal: its states are sets of (place, edits) relative to a
moving base and its transitions depend only on where the next few characters of
the query equal the one read, so they are shared by all queries and remembered.
Neighbouring letters may be exchanged at the cost of one edit. Digits are exact:
no edit may touch one, because a near number is another number.
"""

from __future__ import annotations

from collections.abc import Iterable

State = tuple[tuple[int, int, int], ...]


class Trie:
    """Paths to entries; an entry may have many alias paths."""

    def __init__(self) -> None:
        self.children: list[dict[str, int] | None] = [{}]
        self.ends: list[dict[int, float]] = [{}]
        self.longest = 0

    def add(self, path: str, ref: int, cost: float = 0.0) -> None:
        node = 0
        self.longest = max(self.longest, len(path))
        for c in path:
            nxt = self.children[node].get(c)
            if nxt is None:
                nxt = len(self.children)
                self.children[node][c] = nxt
                self.children.append({})
                self.ends.append({})
            node = nxt
        known = self.ends[node].get(ref)
        if known is None or cost < known:
            self.ends[node][ref] = cost

    def unfold(self, node: int) -> dict[str, int]:
        """The children of a node whose children are not made yet."""
        raise NotImplementedError

    def tidy(self) -> None:
        """Called between searches."""

    def search(self, query: str, edits: int) -> dict[int, float]:
        """All entries with a path within ``edits``, each with its least cost."""
        n, window = len(query), 2 * edits + 2
        if n > self.longest + edits:
            return {}
        where: dict[str, int] = {}
        digits = 0
        for i, c in enumerate(query):
            where[c] = where.get(c, 0) | 1 << i
            if c.isdigit():
                digits |= 1 << i
        mask = (1 << window) - 1
        found: dict[int, float] = {}
        self.tidy()
        children, ends = self.children, self.ends
        stack: list[tuple[int, int, State]] = [(0, 0, ((0, 0, 0),))]
        while stack:
            node, base, state = stack.pop()
            if ends[node]:
                left = n - base
                best = min((e + left - o for o, e, t in state if not t and e + left - o <= edits and not digits >> base + o), default=None)
                if best is not None:
                    for ref, cost in ends[node].items():
                        if best + cost < found.get(ref, 1e9):
                            found[ref] = best + cost
            room = min(n - base, window)
            near = digits >> base & mask
            kids = children[node]
            for c, child in (self.unfold(node) if kids is None else kids).items():
                key = (state, where.get(c, 0) >> base & mask, near, room, c.isdigit(), edits)
                nxt = _STEPS.get(key)
                if nxt is None:
                    nxt = _STEPS[key] = _step(*key)
                if nxt[1]:
                    stack.append((child, base + nxt[0], nxt[1]))
        return found


#: Stands for the point of an abbreviated word, in paths and queries alike.
POINT = "․"

#: Where a reading of an entry stands: entry, words read, whether in order, word at hand and letters of it.
Place = tuple[int, int, bool, int, int]


class NameTrie(Trie):
    """Names of any number of words, unfolded only as far as queries lead.

    Words may stand in any order, each whole, cut short with a point from two letters
    on or without one from five. All these paths together grow with the orders of the
    words; kept are the words alone, so memory grows with their letters, and a node is
    made when a search first comes to it. ``held`` nodes are remembered between searches.
    """

    CUT_POINT, CUT, DISORDER, ALONE = 0.1, 0.3, 0.05, 0.4

    def __init__(self, held: int = 500_000) -> None:
        super().__init__()
        self.names: list[tuple[int, list[str], set[str]]] = []
        self.held = held
        self.places: list[dict[Place, float]] = [{}]

    def add_name(self, ref: int, words: list[str], own: set[str] = frozenset()) -> None:
        """A name; ``own`` are words that stand for it alone."""
        if words:
            self.names.append((ref, words, own))
            self.longest = max(self.longest, sum(map(len, words)) + len(words))
            self._reset()

    def _reset(self) -> None:
        self.children, self.ends, self.places = [None], [{}], [{}]

    def tidy(self) -> None:
        if len(self.children) > self.held:
            self._reset()

    def _start(self) -> dict[Place, float]:
        return {(e, 0, True, w, 0): 0.0 for e, (_, words, _) in enumerate(self.names) for w in range(len(words))}

    def _finish(self, place: Place, cost: float, into: dict[Place, float], ends: dict[int, float]) -> None:
        """A word is read: the name may be complete, or another word begins."""
        e, used, in_order, w, _ = place
        ref, words, own = self.names[e]
        in_order = in_order and used == (1 << w) - 1
        used |= 1 << w
        if used == (1 << len(words)) - 1:
            whole = cost + (0.0 if in_order else self.DISORDER)
            ends[ref] = min(whole, ends.get(ref, whole))
        else:
            for k in range(len(words)):
                if not used >> k & 1:
                    key = (e, used, in_order, k, 0)
                    into[key] = min(cost, into.get(key, cost))
            if used == 1 << w and words[w] in own and cost == 0.0:
                ends[ref] = min(self.ALONE, ends.get(ref, self.ALONE))

    def unfold(self, node: int) -> dict[str, int]:
        after: dict[str, tuple[dict[Place, float], dict[int, float]]] = {}
        for place, cost in (self.places[node] if node else self._start()).items():
            e, used, in_order, w, k = place
            words = self.names[e][1]
            word = words[w]
            into, ends = after.setdefault(word[k], ({}, {}))
            if k + 1 < len(word):
                key = (e, used, in_order, w, k + 1)
                into[key] = min(cost, into.get(key, cost))
                if k + 1 >= 5 and len(words) > 1:
                    self._finish(place, cost + self.CUT, into, ends)
            else:
                self._finish(place, cost, into, ends)
            if 2 <= k and len(words) > 1:
                self._finish(place, cost + self.CUT_POINT, *after.setdefault(POINT, ({}, {})))
        kids = {}
        for c, (into, ends) in after.items():
            kids[c] = len(self.children)
            self.children.append(None if into else {})
            self.places.append(into)
            self.ends.append(ends)
        self.children[node] = kids
        self.places[node] = {}
        return kids


_STEPS: dict[tuple, tuple[int, State]] = {}


def _step(state: State, equal: int, digits: int, room: int, is_digit: bool, edits: int) -> tuple[int, State]:
    least: dict[tuple[int, int], int] = {}

    def put(o: int, t: int, e: int) -> None:
        if e <= edits and e < least.get((o, t), edits + 1):
            least[o, t] = e

    for o, e, t in state:
        if t:
            if o < room and equal >> o & 1:
                put(o + 2, 0, e)
            continue
        if o < room and equal >> o & 1:
            put(o + 1, 0, e)
        if e >= edits:
            continue
        if not is_digit:
            put(o, 0, e + 1)
            if o < room and not digits >> o & 1:
                put(o + 1, 0, e + 1)
            if o + 1 < room and equal >> (o + 1) & 1 and not digits >> o & 3:
                put(o, 1, e + 1)
        skipped = 0
        while e + skipped < edits and o + skipped < room and not digits >> (o + skipped) & 1:
            skipped += 1
            if o + skipped < room and equal >> (o + skipped) & 1:
                put(o + skipped + 1, 0, e + skipped)
    if not least:
        return 0, ()
    shift = min(o for o, _ in least)
    return shift, tuple(sorted((o - shift, e, t) for (o, t), e in least.items()))


def edit_distance(a: str, b: str, digits_exact: bool = True) -> int | None:
    """Brute-force restricted Damerau-Levenshtein distance, for tests; None if impossible."""
    far = 10**6
    fixed = lambda c: digits_exact and c.isdigit()
    d = [[far] * (len(b) + 1) for _ in range(len(a) + 1)]
    d[0][0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j and a[i - 1] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 1][j - 1])
            if i and j and not fixed(a[i - 1]) and not fixed(b[j - 1]):
                d[i][j] = min(d[i][j], d[i - 1][j - 1] + 1)
                if i > 1 and j > 1 and a[i - 2] == b[j - 1] and a[i - 1] == b[j - 2] and not fixed(a[i - 2]) and not fixed(b[j - 2]):
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
            if i and not fixed(a[i - 1]):
                d[i][j] = min(d[i][j], d[i - 1][j] + 1)
            if j and not fixed(b[j - 1]):
                d[i][j] = min(d[i][j], d[i][j - 1] + 1)
    return d[-1][-1] if d[-1][-1] < far else None


def length_dependent_edits(query: str) -> int:
    """Edits allowed for a query: none below 4 letters, 1 below 6, 2 below 13, then 3."""
    letters = sum(c.isalpha() for c in query)
    return 0 if letters < 4 else 1 if letters < 6 else 2 if letters < 13 else 3


def closest(trie: Trie, queries: Iterable[str]) -> tuple[int, int, float] | None:
    """The entry nearest to any reading of a value: the edits it takes, the entry, its distance with the cost of the alias.

    Readings are given best first. Fewer edits win, then the smaller distance, then the
    smaller identifier, so the best of several lists is the best of all.
    """
    readings = [q for q in dict.fromkeys(queries) if q]
    for edits in range(4):
        best = None
        for q in readings:
            if edits <= length_dependent_edits(q):
                for ref, cost in trie.search(q, edits).items():
                    if best is None or (cost, ref) < best:
                        best = (cost, ref)
        if best is not None:
            return edits, best[1], best[0]
    return None
