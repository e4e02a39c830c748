"""Language identification by prediction with partial matching.

One context tree per language holds the counts of every byte after every
context of up to ``order`` bytes. A byte that its context has seen costs
-log2(c / (n + q)) bits; one it hasn't costs the escape -log2(q / (n + q))
and then what the next shorter context charges (n: bytes seen there, q:
distinct ones; below the empty context all 256 bytes are alike). Counts are
frozen after training, so the cost of a byte in its context is a constant
and the exact code length of a text is a sum of these.

Trees are sparse: a level is the sorted codes of the contexts and bytes that
training has seen, so a model's size follows from what it has seen and its
order doesn't depend on how many languages there are. The distinct codes of
a batch of texts are looked up once per language.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plexframe.llm.batches import KEPT, slices, text_views, tidy, with_batches

#: Bytes of context.
ORDER = 3
UNDECIDED = "und"
#: Bytes of text that are coded at once; distinct codes that a counting task holds before it passes them on.
BYTES, HELD = 1 << 20, 1_000_000
#: Slots of the table that numbers a batch's codes.
_SLOT_BITS = 18
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter."""
    return bool(text) and any(c.isalpha() for m in _LETTER.finditer(text) for c in m[0])


def gram_codes(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of each row the code of (its ``order`` predecessors, itself), and the rows' offsets.

    Each text starts in the context of blanks. A code is the bytes as one
    unsigned number, the latest lowest; ``order`` is 3 at most.
    """
    data, offsets = text_views(column)
    starts, lens = offsets[:-1], np.diff(offsets)
    codes = np.zeros(len(data), np.uint32)
    for back in range(order, -1, -1):
        before = np.full(len(data), 0x20, np.uint8)
        before[back:] = data[: len(data) - back]
        for k in range(back):  # a text's first bytes have blanks before them
            before[starts[lens > k] + k] = 0x20
        codes <<= np.uint32(8)
        codes |= before
    return codes, offsets


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and the number of each code among them.

    Codes claim slots of a table; those that lost theirs to another code
    try again with another multiplier.
    """
    number = np.empty(len(codes), np.int32)
    names: list[np.ndarray] = []
    n, rest, step = 0, None, 0x9E3779B1
    while rest is None or len(rest):
        own = codes if rest is None else codes[rest]
        with np.errstate(over="ignore"):
            slot = (own * np.uint32(step)) >> np.uint32(32 - _SLOT_BITS)
        step = (step * 0x85EBCA6B | 1) & 0xFFFFFFFF
        holder = np.zeros(1 << _SLOT_BITS, np.uint32)
        holder[slot] = own
        won = holder[slot] == own
        used = np.zeros(1 << _SLOT_BITS, bool)
        used[slot] = True
        names.append(holder[used])
        rank = (np.cumsum(used, dtype=np.int32) + np.int32(n - 1))[slot]
        if rest is None:
            number[:] = rank
            rest = np.flatnonzero(~won)
        else:
            number[rest[won]] = rank[won]
            rest = rest[~won]
        n += len(names[-1])
    return np.concatenate(names) if names else np.zeros(0, np.uint32), number


@dataclass
class Tree:
    """One language's levels: sorted codes, their counts, and the contexts with n and q."""

    codes: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    n: list[np.ndarray]
    q: list[np.ndarray]

    @classmethod
    def grow(cls, codes: np.ndarray, counts: np.ndarray, order: int) -> Tree:
        """From the counts of the longest contexts' codes; a shorter context sums those that end in it."""
        out = cls([], [], [], [], [])
        for k in range(order + 1):
            own, at = np.unique(codes & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.bincount(at, weights=counts, minlength=len(own))
            context, at = np.unique(own >> np.uint32(8), return_inverse=True)
            out.codes.append(own)
            out.counts.append(c)
            out.contexts.append(context)
            out.n.append(np.bincount(at, weights=c, minlength=len(context)))
            out.q.append(np.bincount(at, minlength=len(context)).astype(np.float64))
        return out

    def costs(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Bits of each of the longest codes of ``endings``, level by level."""
        p = np.full(1, 1 / 256)
        for k, (codes, shorter) in enumerate(levels):
            at, known = _find(self.contexts[k], codes >> np.uint32(8))
            n, q, p = self.n[k][at], self.q[k][at], p[shorter]
            at, seen = _find(self.codes[k], codes)
            p = np.where(known, np.where(seen, self.counts[k][at], q * p) / (n + q), p)
        return -np.log2(p)


def endings(codes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For contexts of 0 to ``order`` bytes: the distinct codes (the longest are given, in order) and where each one's next shorter code is among those before."""
    out = []
    for k in range(order, 0, -1):
        shorter, at = np.unique(codes & np.uint32((1 << 8 * k) - 1), return_inverse=True)
        out.append((codes, at))
        codes = shorter
    return [(codes, np.zeros(len(codes), np.int64)), *out[::-1]]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Model:
    """Frozen counts: for each language the codes seen and how often."""

    order: int
    counts: dict[str, tuple[np.ndarray, np.ndarray]]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def languages(self) -> list[str]:
        return sorted(self.counts)

    def trees(self) -> list[Tree]:
        if _BUILT.get("key") != self.key:
            _BUILT.clear()
            _BUILT.update(key=self.key, trees=[Tree.grow(*self.counts[x], self.order) for x in self.languages])
        return _BUILT["trees"]


_BUILT: dict = {}
KEPT["language"] = _BUILT.clear


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> Model:
    """Counts every context of every row whose text and language are not null.

    The counting is distributed; the driver gets three numbers per language
    and context seen (some hundred thousand for a language in an alphabet,
    whatever the input; never more than 256 ** (order + 1)) and the
    languages' names. Repeated rows count again, very long texts whole. No
    rows: a model of no language.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not names:
        return Model(order, {})
    numbers = {x: k for k, x in enumerate(names)}

    def count(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0

        def flush():
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                times = np.bincount(at, weights=np.concatenate([m for _, m in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), lang, np.int32)), pa.array(codes.view(np.int32)), pa.array(times)], names=["lang", "code", "n"])

        for whole in batches:
            for batch in slices(whole, "text", BYTES):
                codes, offsets = gram_codes(batch.column("text"), order)
                own, number = distinct(codes)
                langs = np.array([numbers[x] for x in batch.column("lang").to_pylist()], np.int32)
                owner = np.repeat(langs, np.diff(offsets))
                for lang in np.unique(langs).tolist():
                    times = np.bincount(number[owner == lang], minlength=len(own))
                    seen = np.flatnonzero(times)
                    held.setdefault(lang, []).append((own[seen], times[seen]))
                    n += len(seen)
                if n > HELD:
                    yield from flush()
                    held, n = {}, 0
        yield from flush()

    seen = rows.mapInArrow(tidy(count), "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = seen.toArrow()
    langs, codes, n = (got[c].to_numpy() for c in ("lang", "code", "n"))
    codes = codes.astype(np.int32).view(np.uint32)
    return Model(order, {x: (codes[langs == k], n[langs == k]) for k, x in enumerate(names) if (langs == k).any()})


def code_lengths(model: Model, column: pa.Array) -> np.ndarray:
    """Bits of each row's text under each language of the model."""
    codes, offsets = gram_codes(column, model.order)
    bits = np.zeros((len(offsets) - 1, len(model.languages)))
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        own, number = distinct(codes)
        by = np.argsort(own)
        rank = np.empty(len(own), np.int32)
        rank[by] = np.arange(len(own), dtype=np.int32)
        levels, number = endings(own[by], model.order), rank[number]
        for k, tree in enumerate(model.trees()):
            bits[filled, k] = np.add.reduceat(tree.costs(levels)[number], offsets[filled])
    return bits


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Appends ``lang_pred`` and ``score`` (the posterior of that language under equal priors).

    Null text, text without a letter, or a model of no language: ``und``,
    score 0. Ties go to the smaller language name. Very long texts are read
    whole, repeated rows each get a result, an empty table stays empty.
    Columns of these names in ``docs`` are replaced.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = handle.value

        def kernel(batch: pa.RecordBatch) -> dict:
            column = batch.column(text_col)
            known = np.array([has_letter(t) for t in column.to_pylist()], bool)
            if not model.languages:
                return {"lang_pred": [UNDECIDED] * len(known), "score": np.zeros(len(known))}
            bits = code_lengths(model, column)
            best = bits.argmin(1)
            score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            names = np.array(model.languages, object)[best]
            return {"lang_pred": np.where(known, names, UNDECIDED), "score": np.where(known, score, 0.0)}

        return kernel

    return with_batches(docs, text_col, make, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), BYTES, "language")


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text falls into the fold that training leaves out (a null id doesn't)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
