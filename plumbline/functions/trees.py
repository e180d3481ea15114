"""Boosted trees of Spark ML over bin codes, for millions of rows with numpy.

Trees tell values of a feature apart by the thresholds they compare them with,
or by the categories they name.  A row is therefore as good as the numbers of
its bins, which are packed into a few bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Rows that are predicted at a time, so that their masks stay in a cache.
ROWS = 16_384
#: Leaves of a tree that one mask holds; larger trees are cut at their top.
LEAVES = 32

_TREE = re.compile(r"Tree \d+ \(weight (\S+)\):")
_TEST = re.compile(r"If \(feature (\d+) (?:<= (\S+)|in \{([^}]*)\})\)")


def _node(lines: Iterator[str]):
    """A leaf's value, or (slot, threshold or categories to the left, left, right)."""
    line = next(lines)
    if line.startswith("Predict: "):
        return float(line.removeprefix("Predict: "))
    slot, threshold, kinds = _TEST.fullmatch(line).groups()
    left = _node(lines)
    next(lines)  # the other branch names the same test
    return int(slot), float(threshold) if threshold else frozenset(int(float(k)) for k in kinds.split(",") if k), left, _node(lines)


def _parsed(text: str) -> list[tuple[float, object]]:
    lines = map(str.strip, text.splitlines())
    return [(float(found[1]), _node(lines)) for found in map(_TREE.fullmatch, lines) if found]


def _tests(node) -> Iterator[tuple[int, object]]:
    if isinstance(node, tuple):
        yield node[:2]
        yield from _tests(node[2])
        yield from _tests(node[3])


def _leaves(node) -> list[float]:
    return [*_leaves(node[2]), *_leaves(node[3])] if isinstance(node, tuple) else [node]


class Forest:
    """The ensembles of a model (one, or one per class) over ``slots`` values of a row.

    ``text`` of an ensemble is its ``toDebugString``, which has thresholds and leaves in full.
    """

    def __init__(self, texts: list[str], slots: int, regression: bool):
        ensembles = [_parsed(text) for text in texts]
        tests = {test for trees in ensembles for _, root in trees for test in _tests(root)}
        self.regression = regression
        #: of each slot its rising thresholds, or the number of categories that trees name
        self.cuts: list = [np.empty(0)] * slots
        for slot in {slot for slot, _ in tests}:
            own = [cut for at, cut in tests if at == slot]
            named = [max(cut, default=-1) for cut in own if isinstance(cut, frozenset)]
            self.cuts[slot] = max(named) + 1 if named else np.unique(own)
        self.sizes = [(cut if isinstance(cut, int) else len(cut)) + 1 for cut in self.cuts]
        #: slots that share a packed number, and the bytes it takes
        self.words: list[tuple[list[int], int]] = []
        room = 0
        for slot, size in enumerate(self.sizes):
            if size == 1:
                continue
            if not self.words or room * size >= 2**62:
                self.words.append(([], 0))
                room = 1
            room *= size
            self.words[-1] = ([*self.words[-1][0], slot], (int(room - 1).bit_length() + 7) // 8)
        self.width = sum(width for _, width in self.words)
        #: numbers that a row packed into one word can be
        self.room = room if len(self.words) == 1 else 0
        self.ensembles = [[self._compiled(root, weight) for weight, root in trees] for trees in ensembles]

    def _goes_left(self, slot: int, cut) -> np.ndarray:
        code = np.arange(self.sizes[slot])
        return np.isin(code, list(cut)) if isinstance(cut, frozenset) else code <= np.searchsorted(self.cuts[slot], cut)

    def _compiled(self, node, weight: float):
        """Masks of the leaves that each code of a slot leaves open; exactly one is open to all slots."""
        values = np.array(_leaves(node)) * weight
        if len(values) > LEAVES:
            slot, cut, left, right = node
            return slot, self._goes_left(slot, cut), self._compiled(left, weight), self._compiled(right, weight)
        tables: dict[int, np.ndarray] = {}

        def close(part, first: int) -> int:
            if not isinstance(part, tuple):
                return first + 1
            slot, cut, left, right = part
            middle = close(left, first)
            end = close(right, middle)
            to_left, to_right = (((1 << b) - (1 << a)) for a, b in ((first, middle), (middle, end)))
            table = tables.setdefault(slot, np.full(self.sizes[slot], 2**32 - 1, np.uint32))
            table &= np.where(self._goes_left(slot, cut), np.uint32(2**32 - 1 - to_right), np.uint32(2**32 - 1 - to_left))
            return end

        close(node, 0)
        if tables:
            next(iter(tables.values()))[:] &= np.uint32((1 << len(values)) - 1)
        return tables, values

    def _run(self, tree, codes: list[np.ndarray]):
        if len(tree) == 4:
            slot, to_left, left, right = tree
            return np.where(to_left[codes[slot]], self._run(left, codes), self._run(right, codes))
        tables, values = tree
        if not tables:
            return values[0]
        first, *others = tables.items()
        open_ = first[1][codes[first[0]]]
        for slot, table in others:
            open_ &= table[codes[slot]]
        return values[(open_.astype(np.float64).view(np.int64) >> 52) - 1023]  # the one bit that is set

    def codes(self, values: list[np.ndarray]) -> list[np.ndarray]:
        """Of each slot the number of its bin: how many thresholds lie below, or the category."""
        return [
            np.minimum(v.astype(np.int64), cut) if isinstance(cut, int) else np.searchsorted(cut, v).astype(np.int64)
            for v, cut in zip(values, self.cuts, strict=True)
        ]

    def _numbers(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        found = []
        for slots, _ in self.words:
            number = np.zeros(len(codes[0]), np.int64)
            for slot in slots:
                number = number * self.sizes[slot] + codes[slot]
            found.append(number)
        return found

    def _codes_of(self, numbers: list[np.ndarray], rows: int) -> list[np.ndarray]:
        codes = [np.zeros(rows, np.int64)] * len(self.sizes)
        for number, (slots, _) in zip(numbers, self.words, strict=True):
            for slot in reversed(slots):
                number, codes[slot] = np.divmod(number, self.sizes[slot])
        return codes

    def pack(self, codes: list[np.ndarray]) -> np.ndarray:
        """A row of ``width`` bytes per row."""
        rows = len(codes[0])
        parts = [n.astype("<i8").view(np.uint8).reshape(rows, 8)[:, :width] for n, (_, width) in zip(self._numbers(codes), self.words, strict=True)]
        return np.concatenate([np.empty((rows, 0), np.uint8), *parts], axis=1)

    def unpack(self, packed: np.ndarray) -> list[np.ndarray]:
        numbers, at = [], 0
        for _, width in self.words:
            whole = np.zeros((len(packed), 8), np.uint8)
            whole[:, :width] = packed[:, at : at + width]
            numbers.append(whole.view("<i8").ravel())
            at += width
        return self._codes_of(numbers, len(packed))

    def _predict(self, codes: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(codes[0]))
        for at in range(0, len(out), ROWS):
            own = [c[at : at + ROWS] for c in codes]
            margins = []
            for trees in self.ensembles:
                total = np.zeros(len(own[0]))
                for tree in trees:
                    total += self._run(tree, own)
                margins.append(total)
            if self.regression:
                out[at : at + ROWS] = margins[0]
            else:
                out[at : at + ROWS] = margins[0] > 0 if len(margins) == 1 else np.argmax(margins, axis=0)
        return out

    def predict(self, codes: list[np.ndarray]) -> np.ndarray:
        """Predictions of rows; rows that are equal to trees are predicted once."""
        if not self.room:
            return self._predict(codes)
        number = self._numbers(codes)[0]
        if self.room > 4 * len(number):
            own, back = np.unique(number, return_inverse=True)
            return self._predict(self._codes_of([own], len(own)))[back]
        held = np.zeros(self.room)
        held[number] = 1.0
        own = np.flatnonzero(held)
        held[own] = self._predict(self._codes_of([own], len(own)))
        return held[number]
