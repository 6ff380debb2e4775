"""Values of text parts, computed once for those that come again."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class PartMemo:
    """Most parts of a corpus are few and frequent, most distinct parts are rare.

    A part met for the first time waits among the ``fresh`` ones, which are dropped when they are too
    many. One met again there is ``known``. When those are too many they become the ``old`` ones, from
    which parts still in use are taken over, in place of the old ones before them. Each of the three
    holds about ``most`` parts of at most ``longest`` characters; longer parts are computed each time. No
    value may be None.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable[Any]], most: int, longest: int = 64):
        self.compute, self.most, self.longest = compute, most, longest
        self.known: dict[str, Any] = {}
        self.old: dict[str, Any] = {}
        self.fresh: dict[str, Any] = {}
        # The memo's many small objects form no cycles; looking through them all the time costs a fifth.
        gc.set_threshold(200_000, 20, 50)

    def values(self, parts: Iterable[str]) -> dict[str, Any]:
        """A value for each of the distinct ``parts``."""
        found, new = {}, []
        known, old, fresh = self.known, self.old, self.fresh
        for part in parts:
            value = known.get(part)
            if value is None:
                value = old.pop(part, None)
                if value is None:
                    value = fresh.pop(part, None)
                if value is None:
                    new.append(part)
                    continue
                known[part] = value
            found[part] = value
        if len(known) > self.most:
            self.known, self.old = {}, known
        if new:
            made = dict(zip(new, self.compute(new), strict=True))
            found.update(made)
            if len(fresh) + len(made) > self.most:
                self.fresh = {}
            self.fresh.update((p, v) for p, v in made.items() if len(p) <= self.longest)
        return found

    def lookup(self, parts: pa.Array) -> tuple[np.ndarray, list[Any]]:
        """The number of each part's value, and the values of the distinct parts."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = self.values(distinct)
        return coded.indices.to_numpy(), [found[p] for p in distinct]


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts between single spaces, and where each text's begin; null is empty."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    return lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])


def joined(values: list[bytes], codes: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    """For each text the values of its parts, one after the other; ``bounds`` say where its parts begin."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(codes))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64)[taken.offset:taken.offset + len(taken) + 1][bounds].tolist()
    whole = memoryview(data if data is not None else b"")
    return [whole[i:j] for i, j in zip(ends, ends[1:])]


def any_of(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether any part of each text is flagged."""
    before = np.concatenate([[0], np.cumsum(flags)])[bounds]
    return before[1:] > before[:-1]
