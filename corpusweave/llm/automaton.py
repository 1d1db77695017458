"""One deterministic automaton out of many regular grammars; of a match it knows which characters are the value.

A grammar is a list of (regular expression, is it part of the value). All grammars are one nondeterministic automaton, and its
determinised states are made when they are first met, so that only those that texts lead to exist. Characters beyond ASCII are
one symbol. A run from a place takes one step a character and gives the longest match.
"""

from __future__ import annotations

from collections.abc import Sequence
from re import _constants as sre
from re import _parser

SYMBOLS = 129  # ASCII and one for all others
_ALL = (1 << SYMBOLS) - 1
_CLASSES = {
    sre.CATEGORY_SPACE: sum(1 << c for c in range(128) if chr(c).isspace()),
    sre.CATEGORY_DIGIT: sum(1 << ord(c) for c in "0123456789"),
    sre.CATEGORY_WORD: sum(1 << c for c in range(128) if chr(c).isalnum() or c == 95),
}


class _State:
    __slots__ = ("accept", "after", "parts", "value")

    def __init__(self, parts: frozenset[int], value: int, accept: int):
        self.parts, self.value, self.accept = parts, value, accept
        self.after: list[_State | None] = [None] * SYMBOLS


class Automaton:
    def __init__(self, grammars: Sequence[Sequence[tuple[str, bool]]], ignore_case: Sequence[bool]):
        self.free: list[list[int]] = []  # steps without a character
        self.steps: list[list[tuple[int, int, int]]] = []  # (characters as bits, target, bit of the grammar whose value it is of)
        self.final: dict[int, int] = {}
        self.made: dict[tuple[frozenset[int], int], _State] = {}
        begin = self._new()
        for rule, (grammar, fold) in enumerate(zip(grammars, ignore_case)):
            at = self._new()
            self.free[begin].append(at)
            for expression, value in grammar:
                at = self._build(_parser.parse(expression), at, 1 << rule if value else 0, fold)
            self.final[at] = rule
        self.dead = _State(frozenset(), 0, -1)
        self.begin = self._made({begin}, 0)

    def _new(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def _build(self, tree, at: int, value: int, fold: bool) -> int:
        """Append a parsed expression behind the state `at`; gives the state behind it."""
        for op, arg in tree:
            if op is sre.SUBPATTERN:
                at = self._build(arg[-1], at, value, fold)
            elif op is sre.BRANCH:
                end = self._new()
                for branch in arg[1]:
                    self.free[self._build(branch, at, value, fold)].append(end)
                at = end
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                least, most, body = arg
                for _ in range(least):
                    at = self._build(body, at, value, fold)
                if most is sre.MAXREPEAT:
                    loop, end = self._new(), self._new()
                    self.free[at].append(loop)
                    self.free[self._build(body, loop, value, fold)].append(loop)
                    self.free[loop].append(end)
                    at = end
                else:
                    end = self._new()
                    for _ in range(most - least):
                        self.free[at].append(end)
                        at = self._build(body, at, value, fold)
                    self.free[at].append(end)
                    at = end
            else:
                to = self._new()
                self.steps[at].append((self._set(op, arg, fold), to, value))
                at = to
        return at

    def _set(self, op, arg, fold: bool) -> int:
        if op is sre.LITERAL:
            bits = 1 << min(arg, 128)
        elif op is sre.NOT_LITERAL:
            bits = _ALL & ~(1 << arg)
        elif op is sre.ANY:
            bits = _ALL & ~(1 << 10)
        elif op is sre.IN:
            bits, negated = 0, False
            for kind, x in arg:
                if kind is sre.NEGATE:
                    negated = True
                elif kind is sre.RANGE:
                    bits |= sum(1 << c for c in range(x[0], min(x[1], 128) + 1))
                elif kind is sre.CATEGORY:
                    bits |= _CLASSES[x]
                else:
                    bits |= self._set(kind, x, False)
            bits = _ALL & ~bits if negated else bits
        else:
            raise ValueError(f"not a regular expression: {op}")
        if fold:
            small, large = bits >> 97 & (1 << 26) - 1, bits >> 65 & (1 << 26) - 1
            bits |= small << 65 | large << 97
        return bits

    def _made(self, parts: set[int], value: int) -> _State:
        todo, parts = list(parts), set(parts)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in parts:
                    parts.add(to)
                    todo.append(to)
        key = frozenset(parts), value
        if key not in self.made:
            self.made[key] = _State(key[0], value, min((self.final[p] for p in parts if p in self.final), default=-1))
        return self.made[key]

    def _after(self, state: _State, symbol: int) -> _State:
        parts, value = set(), 0
        for p in state.parts:
            for bits, to, of_value in self.steps[p]:
                if bits >> symbol & 1:
                    parts.add(to)
                    value |= of_value
        state.after[symbol] = to = self._made(parts, value) if parts else self.dead
        return to

    def match(self, text: str, start: int) -> tuple[int, int, list[tuple[int, int]]] | None:
        """(grammar, end, spans of the value) of the longest match that begins at start; of equal ones the first grammar."""
        state, rule, end, marks = self.begin, -1, start, []
        dead, at = self.dead, start
        size = len(text)
        while at < size:
            symbol = ord(text[at])
            if symbol > 127:
                symbol = 128
            state = state.after[symbol] or self._after(state, symbol)
            if state is dead:
                break
            if state.value:
                marks.append((at, state.value))
            at += 1
            if state.accept >= 0:
                rule, end = state.accept, at
        if rule < 0:
            return None
        spans: list[list[int]] = []
        for i, of in marks:
            if i >= end:
                break
            if not of >> rule & 1:
                continue
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        return rule, end, [(a, b) for a, b in spans]

