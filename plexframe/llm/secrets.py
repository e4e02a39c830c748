"""Secret scanning with combined deterministic automata.

All rules run over the bytes of the text as minimal transition arrays (see
automaton.py), compiled together in two groups: counted repeats that can
overlap multiply each other's states, so the base rules and the further ones
have an automaton each. Some bytes, such as line feeds, lead every state
back to the start; where no rule has them inside a match either, a batch of
texts is cut behind them and its segments are scanned side by side. A
segment in which an automaton accepts a rule holds a match of it. There the
rule's backward automaton marks where matches start and its anchored one
finds where the longest ends.

Spans are (kind, start, end) in code points, end exclusive. Per kind they are
leftmost and don't overlap; one that fails its length check is dropped.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from plexframe.llm.automaton import Automaton, alphabet, compile_rules
from plexframe.llm.batches import text_views, with_batches

BASE = ("assign", "access", "hex")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The names of assigned secrets.
_NAMES = "(" + "|".join(_either_case(x) for x in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_BEFORE = "[\"']?\\x20*[:=]\\x20*[\"']?"

#: kind: (its grammar, what must be there at least for the combined automaton to accept, a group and the least length it needs).
RULES: dict[str, tuple[str, str, int, int]] = {
    "assign": (_NAMES + _BEFORE + "([A-Za-z0-9+/_.=-]+)", _NAMES + _BEFORE + "[A-Za-z0-9+/_.=-]{6}", 2, 6),
    "access": ("AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16}", 0, 20),
    "hex": ("[0-9a-f]+", "[0-9a-f]{24}", 0, 24),
    "private_key": ("-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 0),
    "github": ("gh[pousr]_[A-Za-z0-9]{36}", "gh[pousr]_[A-Za-z0-9]{36}", 0, 0),
    "slack": ("xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]{10}", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{7,}\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]", 0, 0),
    "url_password": ("://[A-Za-z0-9._%-]+:[A-Za-z0-9._%!$*+-]+@", "://[A-Za-z0-9._%-]+:[A-Za-z0-9._%!$*+-]+@", 0, 0),
}
KINDS = tuple(RULES)
GROUPS = (BASE, tuple(k for k in KINDS if k not in BASE))
#: Bytes that no match of a grammar holds; only behind these may a text be cut.
_OUTSIDE = np.array([b not in frozenset().union(*(alphabet(x[0]) for x in RULES.values())) for b in range(256)])


@dataclass
class Scanner:
    """The combined automata, one per group, and each rule's own: where matches start, and where one ends."""

    groups: list[Automaton]
    starts: dict[str, Automaton]
    ends: dict[str, Automaton]

    @property
    def cuts(self) -> np.ndarray:
        """The bytes behind which a text may be cut: no character, match or automaton's state goes on there."""
        out = _OUTSIDE & (np.arange(256) < 128)
        for group in self.groups:
            out = out & group.reset
        return out

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A bit per kind for every segment."""
        out, shift = np.zeros(len(starts), np.int64), 0
        for names, group in zip(GROUPS, self.groups, strict=True):
            out |= group.scan(data, starts, ends) << shift
            shift += len(names)
        return out

    def bounds(self, kind: str, raw: bytes) -> list[tuple[int, int]]:
        """One kind's matches in a segment, leftmost and longest; those of sufficient length."""
        _, _, group, least = RULES[kind]
        out, done = [], 0
        for start in self.starts[kind].marks(raw):
            if start < done:
                continue
            done = self.ends[kind].longest(raw, start)
            if least:
                m = _EXACT[kind].fullmatch(raw[start:done].decode())
                if m.end(group) - m.start(group) < least:
                    continue
            out.append((start, done))
        return out


_EXACT = {k: re.compile(x[0]) for k, x in RULES.items()}


@cache
def scanner() -> Scanner:
    """Compiled once on the driver and broadcast; its size is fixed by the rules."""
    return Scanner(
        [compile_rules({k: RULES[k][1] for k in names}) for names in GROUPS],
        {k: compile_rules({k: x[0]}, backward=True) for k, x in RULES.items()},
        {k: compile_rules({k: x[0]}, anchored=True) for k, x in RULES.items()},
    )


def find_all(column: pa.Array, rules: Scanner) -> list[list[tuple[str, int, int]]]:
    """The spans of every text of a column, by start and then kind; none for null."""
    data, offsets = text_views(column)
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(rules.cuts[data]) + 1]))
    starts, ends = cuts[:-1], cuts[1:]
    bits = rules.scan(data, starts, ends)
    raw = data.tobytes()
    done, chars, row = 0, 0, -1
    for k in np.flatnonzero(bits):
        start, end = int(starts[k]), int(ends[k])
        owner = int(np.searchsorted(offsets, start, "right")) - 1
        if owner != row:
            row, done, chars = owner, int(offsets[owner]), 0
        chars += len(raw[done:start].decode())
        done = start
        segment = raw[start:end]
        before = None if segment.isascii() else np.r_[0, np.cumsum((data[start:end] & 0xC0) != 0x80)]  # characters before each byte
        for j, kind in enumerate(KINDS):
            if bits[k] >> j & 1:
                for a, b in rules.bounds(kind, segment):
                    at = chars + (a if before is None else int(before[a]))
                    out[row].append((kind, at, at + b - a))  # a match is ASCII
    for spans in out:
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Appends n_assign, n_access, n_hex, base_sha256 and spans; null text counts as empty.

    Very long texts are scanned whole, repeated rows each return, an empty
    table stays empty. Spans of the same start are ordered as the kinds are
    listed. Columns of these names in ``docs`` are replaced.
    """
    added = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(x, T.StringType()) for x in ("base_sha256", "spans")])

    handle = docs.sparkSession.sparkContext.broadcast(scanner())

    def make():
        rules = handle.value

        def kernel(batch: pa.RecordBatch) -> dict:
            spans = find_all(batch.column(text_col), rules)
            base = [[s for s in x if s[0] in BASE] for x in spans]
            return {f"n_{k}": [sum(s[0] == k for s in x) for x in base] for k in BASE} | {
                "base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in base],
                "spans": [joined(x) for x in spans],
            }

        return kernel

    return with_batches(docs, text_col, make, added)
