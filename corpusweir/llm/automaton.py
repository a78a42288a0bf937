"""Regular expressions compiled into one minimal automaton over bytes.

Expressions are parsed into trees, turned into a nondeterministic automaton,
made deterministic by subset construction and minimised by partition refinement.
Several expressions share one automaton whose states know which of them match.
Supported: literals, ``\\xHH`` and escaped punctuation, classes, groups ``(?:..)``
and ``(?i:..)``, ``|``, ``?``, ``*``, ``+`` and counted repetition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    """Trees: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most or None)."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        tree = self.either(False)
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def either(self, fold: bool):
        parts = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence(fold))
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self, fold: bool):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(fold))
        return ("cat", parts)

    def repeated(self, fold: bool):
        part = self.atom(fold)
        while self.peek() in ("?", "*", "+", "{"):
            c = self.take()
            if c == "{":
                inside = ""
                while self.peek() != "}":
                    inside += self.take()
                self.take()
                low, _, high = inside.partition(",")
                least, most = int(low), (int(high) if high else None) if "," in inside else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            part = ("rep", part, least, most)
        return part

    def atom(self, fold: bool):
        c = self.take()
        if c == "(":
            for opening, inner in (("?:", fold), ("?i:", True)):
                if self.p.startswith(opening, self.i):
                    self.i += len(opening)
                    fold = inner
                    break
            tree = self.either(fold)
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.take()
            return tree
        if c == "[":
            return ("set", self.inside_class())
        if c in ".^$":
            raise ValueError(f"{c!r} is not supported")
        value = self.escaped() if c == "\\" else ord(c)
        both = {value}
        if fold and chr(value).isalpha():
            both = {ord(chr(value).lower()), ord(chr(value).upper())}
        return ("set", frozenset(both))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        if c.isalnum():
            raise ValueError(f"\\{c} is not supported")
        return ord(c)

    def inside_class(self) -> frozenset[int]:
        chosen: set[int] = set()
        while self.peek() != "]":
            low = self.escaped() if (c := self.take()) == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                high = self.escaped() if (c := self.take()) == "\\" else ord(c)
            chosen.update(range(low, high + 1))
        self.take()
        return frozenset(chosen)


def byte_set(pattern: str) -> frozenset[int]:
    """The bytes of one class."""
    tree = _Parser(pattern).parse()
    return tree[1][0][1]


class _Nfa:
    def __init__(self) -> None:
        self.silent: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.silent.append([])
        self.moves.append(None)
        return len(self.silent) - 1

    def add(self, tree, backwards: bool) -> tuple[int, int]:
        kind = tree[0]
        if kind == "set":
            a, b = self.state(), self.state()
            self.moves[a] = (tree[1], b)
            return a, b
        if kind == "cat":
            a = last = self.state()
            for part in reversed(tree[1]) if backwards else tree[1]:
                s, e = self.add(part, backwards)
                self.silent[last].append(s)
                last = e
            return a, last
        if kind == "or":
            a, b = self.state(), self.state()
            for part in tree[1]:
                s, e = self.add(part, backwards)
                self.silent[a].append(s)
                self.silent[e].append(b)
            return a, b
        _, part, least, most = tree
        a = last = self.state()
        for _ in range(least):
            s, e = self.add(part, backwards)
            self.silent[last].append(s)
            last = e
        if most is None:
            s, e = self.add(part, backwards)
            b = self.state()
            self.silent[last] += [s, b]
            self.silent[e] += [s, b]
            return a, b
        b = self.state()
        for _ in range(most - least):
            s, e = self.add(part, backwards)
            self.silent[last] += [s, b]
            last = e
        self.silent[last].append(b)
        return a, b

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.silent[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    """Transition arrays: ``table[state * width + byte_class[b]]`` is ``next * width``."""

    byte_class: np.ndarray
    table: np.ndarray
    width: int
    start: int
    matches: np.ndarray
    first_match: int

    @property
    def size(self) -> int:
        return len(self.matches)


def compile_all(patterns: list[str], backwards: bool = False, anywhere: bool = False) -> Automaton:
    """One automaton for all patterns.

    ``backwards`` reads the text from its end; ``anywhere`` lets a match begin at
    every byte.  Bit k of ``matches[state]`` tells that pattern k just matched;
    states from ``first_match`` on match something.
    """
    nfa = _Nfa()
    ends, starts = {}, []
    for k, p in enumerate(patterns):
        s, e = nfa.add(_Parser(p).parse(), backwards)
        starts.append(s)
        ends[e] = k
    sets = {m[0] for m in nfa.moves if m}
    signature: dict[tuple, int] = {}
    byte_class = np.zeros(256, np.int64)
    for b in range(256):
        byte_class[b] = signature.setdefault(tuple(b in s for s in sets), len(signature))
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(signature))]
    width = len(sample)
    # A state of the subset construction is kept as its moving and final members only.
    useful = [m is not None or i in ends for i, m in enumerate(nfa.moves)]
    closures = {
        m[1]: frozenset(t for t in nfa.closure([m[1]]) if useful[t]) for m in nfa.moves if m
    }
    origin = frozenset(t for t in nfa.closure(starts) if useful[t])
    number, rows, todo = {origin: 0}, [], [origin]
    for states in todo:
        row = []
        moves = [nfa.moves[s] for s in states if nfa.moves[s]]
        for b in sample:
            reached: set[int] = set(origin) if anywhere else set()
            for wanted, target in moves:
                if b in wanted:
                    reached |= closures[target]
            key = frozenset(reached)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            row.append(number[key])
        rows.append(row)
    table = np.array(rows, np.int64)
    found = np.zeros(len(todo), np.int64)
    for i, states in enumerate(todo):
        for s in states:
            if s in ends:
                found[i] |= 1 << ends[s]
    # Minimise: refine the partition by what is matched until successors agree.
    _, block = np.unique(found, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    n = block.max() + 1
    chosen = np.zeros(n, np.int64)
    chosen[block] = np.arange(len(block))
    order = np.argsort(found[chosen] > 0, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    chosen = chosen[order]
    return Automaton(
        byte_class=byte_class.astype(np.int32),
        table=(rank[block[table[chosen]]] * width).astype(np.int32).ravel(),
        width=width,
        start=int(rank[block[0]]) * width,
        matches=found[chosen],
        first_match=int((found[chosen] == 0).sum()) * width,
    )


LANE = 2048


def hits(auto: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a matching state is reached, and those states.

    The bytes are cut into lanes that advance together, one step of all lanes at a
    time.  A lane is first read from the start state; lanes whose true entry state is
    another one are read again until both readings meet, so the result is that of one
    pass from the beginning, whatever the lanes hold.
    """
    lanes = -(-len(data) // LANE)
    symbols = np.zeros(lanes * LANE, np.int32)
    symbols[: len(data)] = auto.byte_class[data]
    grid = np.ascontiguousarray(symbols.reshape(lanes, LANE).T)
    table, width, first = auto.table, auto.width, auto.first_match
    state = np.full(lanes, auto.start, np.int32)
    at, what = [], []
    for i in range(LANE):
        state = table.take(state + grid[i])
        hot = np.flatnonzero(state >= first)
        if len(hot):
            at.append(hot * LANE + i)
            what.append(state[hot])
    exits, assumed = state, np.full(lanes, auto.start, np.int32)
    found = dict(zip(np.concatenate(at).tolist(), np.concatenate(what).tolist(), strict=True)) if at else {}
    while True:
        entry = np.concatenate(([auto.start], exits[:-1])).astype(np.int32)
        lane = np.flatnonzero(entry != assumed)
        if not len(lane):
            break
        old, new = assumed[lane], entry[lane]
        assumed[lane] = new
        for i in range(LANE):
            old, new = table.take(old + grid[i, lane]), table.take(new + grid[i, lane])
            for k in np.flatnonzero((old >= first) | (new >= first)):
                place = int(lane[k]) * LANE + i
                found.pop(place, None)
                if new[k] >= first:
                    found[place] = int(new[k])
            apart = old != new
            if not apart.all():
                lane, old, new = lane[apart], old[apart], new[apart]
                if not len(lane):
                    break
        else:
            exits[lane] = new
    places = np.fromiter(found, np.int64, len(found))
    order = np.argsort(places)
    places = places[order]
    states = np.fromiter(found.values(), np.int64, len(found))[order] // width
    keep = places < len(data)
    return places[keep], states[keep]


def longest(auto: Automaton, data: bytes, start: int) -> int:
    """End of the longest match that begins at ``start``; -1 without one.  ``auto`` is anchored."""
    state, end = auto.start, -1
    if state >= auto.first_match:
        end = start
    dead = _dead(auto)
    table, classes = auto.table, auto.byte_class
    for i in range(start, len(data)):
        state = int(table[state + classes[data[i]]])
        if state >= auto.first_match:
            end = i + 1
        elif state == dead:
            break
    return end


def _dead(auto: Automaton) -> int:
    grid = auto.table.reshape(auto.size, auto.width)
    stuck = (grid == np.arange(auto.size)[:, None] * auto.width).all(axis=1) & (auto.matches == 0)
    where = np.flatnonzero(stuck)
    return int(where[0]) * auto.width if len(where) else -1
