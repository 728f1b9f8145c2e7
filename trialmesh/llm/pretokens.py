"""Pre-tokens of texts, each distinct one handled once: what the token operators share inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

KEEP = 200_000


class Pieces(dict):
    """Number of every distinct pre-token seen by this task; ``encode`` turns the new ones of a batch into id lists.

    ``starts`` and ``sizes`` say where in ``flat`` the ids of a pre-token lie.  Emptied by ``trim`` beyond ``KEEP``
    entries, so its memory does not follow the input.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[list[int]]]):
        super().__init__()
        self.find, self.encode, self.new = regex.compile(pattern).findall, encode, []
        self.clear()

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number

    def clear(self) -> None:
        super().clear()
        self.new, self.sizes, self.starts, self.flat = [], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def trim(self) -> None:
        if len(self) > KEEP:
            self.clear()

    def numbers(self, pieces) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))

    def settle(self) -> None:
        """Encode what is new."""
        if self.new:
            ids = self.encode(self.new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.sizes = np.append(self.sizes, sizes)
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
            self.flat = np.append(self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())))
            self.new = []

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of a row of pre-tokens."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(total)]
