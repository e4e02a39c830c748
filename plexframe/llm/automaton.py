"""Regular expressions over bytes compiled into one minimal deterministic automaton.

``compile_rules`` parses every rule (literals, escapes, classes, groups,
alternation, ``? * + {m} {m,} {m,n}``), joins them into one
nondeterministic automaton that searches at every position, determinises it
by subset construction, minimises it by partition refinement and returns
transition arrays over byte classes. ``Automaton.scan`` then runs all rules
over many byte segments at once, one transition per byte. Compiled backward
an automaton marks where matches start, compiled anchored it finds where the
longest one ends.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

_UNBOUNDED = -1
#: With fewer segments left than this, stepping through each by itself is faster.
_FEW = 48


class _Parser:
    """Recursive descent over a pattern; nodes are tuples (kind, ...)."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        node = self.alternation()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} of {self.p!r}")
        return node

    def more(self) -> bool:
        return self.i < len(self.p)

    def alternation(self):
        options = [self.sequence()]
        while self.more() and self.p[self.i] == "|":
            self.i += 1
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.more() and self.p[self.i] not in "|)":
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        node = self.atom()
        while self.more() and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                node = ("rep", node, int(low), int(low) if not comma else int(high) if high else _UNBOUNDED)
                self.i = end + 1
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else _UNBOUNDED)
        return node

    def atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            node = self.alternation()
            if not self.more() or self.p[self.i] != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.char_class())
        if c == "\\":
            return ("set", frozenset([self.escape()]))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("bytes", c.encode())

    def escape(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def char_class(self) -> frozenset:
        negated = self.p[self.i] == "^"
        self.i += negated
        out: set[int] = set()
        first = True
        while first or self.p[self.i] != "]":
            first = False
            low = self.member()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                out.update(range(low, self.member() + 1))
            else:
                out.add(low)
        self.i += 1
        return frozenset(range(256)) - out if negated else frozenset(out)

    def member(self) -> int:
        c = self.p[self.i]
        self.i += 1
        return self.escape() if c == "\\" else ord(c)


def alphabet(pattern: str) -> frozenset:
    """The bytes that a match of the pattern may hold."""

    def of(node) -> frozenset:
        kind, what = node[:2]
        if kind == "rep":
            return of(what)
        return frozenset().union(*map(of, what)) if kind in ("seq", "or") else frozenset(what)

    return of(_Parser(pattern).parse())


class _Nfa:
    def __init__(self, backward: bool = False):
        self.order = -1 if backward else 1
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def build(self, node, start: int) -> int:
        """Adds the node from a state on; returns its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.steps[start].append((node[1], end))
            return end
        if kind == "bytes":
            for b in node[1][:: self.order]:
                end = self.state()
                self.steps[start].append((frozenset([b]), end))
                start = end
            return start
        if kind == "seq":
            for part in node[1][:: self.order]:
                start = self.build(part, start)
            return start
        if kind == "or":
            end = self.state()
            for option in node[1]:
                self.empty[self.build(option, start)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.build(part, start)
        if high == _UNBOUNDED:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.build(part, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.build(part, start)
            self.empty[start].append(end)
        return end


@dataclass
class Automaton:
    """``step[state * n_classes + class]`` is the next state times n_classes; ``accept`` has a bit per rule."""

    names: list[str]
    byte_class: np.ndarray
    n_classes: int
    step: np.ndarray
    accept: np.ndarray
    reset: np.ndarray

    @property
    def n_states(self) -> int:
        return len(self.accept)

    @cached_property
    def _plain(self) -> tuple[bytes, list[int], list[int]]:
        """The byte classes, transitions and (by state times n_classes) bits as plain Python values."""
        bits = [0] * len(self.step)
        for k, b in enumerate(self.accept.tolist()):
            bits[k * self.n_classes] = b
        return bytes(self.byte_class.astype(np.uint8)), self.step.tolist(), bits

    @cached_property
    def _dead(self) -> int:
        """The state that nothing leads out of and that accepts nothing, times n_classes; -1 if there is none."""
        step = self.step.reshape(-1, self.n_classes)
        own = np.arange(len(step)) * self.n_classes
        at = np.flatnonzero((step == own[:, None]).all(1) & (self.accept == 0))
        return int(own[at[0]]) if len(at) else -1

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of the rules that match anywhere in each segment data[start:end]."""
        hits = np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first: the lanes still active are a prefix
        at, lens = starts[order].astype(np.int64), (ends - starts)[order]
        state = np.zeros(len(order), np.int32)
        got = np.zeros(len(order), np.uint8 if len(self.names) <= 8 else np.int64)
        classes = self.byte_class.astype(np.uint8)[data]
        # A state's bits, found by its number times n_classes without dividing.
        bits = np.zeros(len(self.step), got.dtype)
        bits[:: self.n_classes] = self.accept
        active, k = len(order), 0
        while k < (int(lens[0]) if len(lens) else 0):
            while active and lens[active - 1] <= k:
                active = int(np.searchsorted(-lens, -k, "left"))
            if active < _FEW:
                break
            own = state[:active]
            own += classes.take(at[:active])
            self.step.take(own, out=own, mode="clip")
            got[:active] |= bits.take(own)
            at[:active] += 1
            k += 1
        _, step, plain = self._plain
        for lane in range(active):
            s, seen = int(state[lane]), 0
            for c in classes[at[lane] : at[lane] + lens[lane] - k].tobytes():
                s = step[s + c]
                if plain[s]:
                    seen |= plain[s]
            got[lane] |= seen
        hits[order] = got
        return hits

    def marks(self, raw: bytes) -> list[int]:
        """Of an automaton compiled backward: where matches start, in ascending order."""
        table, step, plain = self._plain
        s, out = 0, []
        classes = raw.translate(table)
        for i in range(len(raw) - 1, -1, -1):
            s = step[s + classes[i]]
            if plain[s]:
                out.append(i)
        return out[::-1]

    def longest(self, raw: bytes, start: int) -> int:
        """Of an anchored automaton: where the longest match from ``start`` on ends, -1 if there is none."""
        table, step, plain = self._plain
        s, last = 0, -1
        for i in range(start, len(raw)):
            s = step[s + table[raw[i]]]
            if s == self._dead:
                break
            if plain[s]:
                last = i + 1
        return last


def compile_rules(rules: dict[str, str], anchored: bool = False, backward: bool = False) -> Automaton:
    """One automaton for all rules, at most 63 of them.

    It searches at every position unless it is anchored; a backward one
    reads its text from the end.
    """
    nfa = _Nfa(backward)
    root = nfa.state()
    finals: dict[int, int] = {}
    for k, pattern in enumerate(rules.values()):
        start = nfa.state()
        nfa.empty[root].append(start)
        end = nfa.build(_Parser(pattern).parse(), start)
        finals[end] = finals.get(end, 0) | 1 << k

    # Bytes that no transition tells apart share a class.
    sets = {s for steps in nfa.steps for s, _ in steps}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {x: k for k, x in enumerate(dict.fromkeys(signature))}
    byte_class = np.array([kinds[x] for x in signature], np.int32)
    sample = {kinds[x]: b for b, x in reversed(list(enumerate(signature)))}

    def closure(states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    begin = closure([root])
    index, rows, queue = {begin: 0}, [], [begin]
    for current in queue:
        row = []
        for c in range(len(kinds)):
            b = sample[c]
            target = closure({t for s in current for on, t in nfa.steps[s] if b in on} | (set() if anchored else {root}))
            if target not in index:
                index[target] = len(index)
                queue.append(target)
            row.append(index[target])
        rows.append(row)
    step = np.array(rows, np.int64).reshape(len(rows), len(kinds))
    accept = np.array([sum({finals[s] for s in x if s in finals}) for x in queue], np.int64)

    # Minimisation: states stay together while their bits and successors' blocks agree.
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    rank = np.full(block.max() + 1, -1)
    for x in block:  # the start state's block is number 0
        if rank[x] < 0:
            rank[x] = rank.max() + 1
    block = rank[block]
    first = np.unique(block, return_index=True)[1]
    step, accept = block[step[first]], accept[first]
    reset = (step == 0).all(0)[byte_class]
    return Automaton(list(rules), byte_class, len(kinds), (step * len(kinds)).astype(np.int32).reshape(-1), accept, reset)
