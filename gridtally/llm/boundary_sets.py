"""Sets of text offsets that are selected from by rank, laid out like a Roaring bitmap.

Offsets are split by their high 16 bits. The low halves that share a high half form a
container in whichever of three layouts takes the fewest bytes: a sorted array, a bitmap
of 65,536 bits, or runs of neighbouring offsets. Cumulative cardinalities over the
containers find the one that holds a rank; a local select inside it gives the offset.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Offsets a container spans.
SPAN = 1 << 16
_BITMAP_BYTES = SPAN // 8


@dataclass(frozen=True)
class ArrayContainer:
    """Sorted low halves."""

    low: np.ndarray

    def select(self, rank: int) -> int:
        return int(self.low[rank])


@dataclass(frozen=True)
class BitmapContainer:
    """One bit for each low half, in words of 64, with the bits before each word counted."""

    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, member: np.ndarray) -> BitmapContainer:
        padded = np.zeros(SPAN, dtype=bool)
        padded[: len(member)] = member
        words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(words, np.cumsum(counts) - counts)

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.before, rank, side="right")) - 1
        bits = np.unpackbits(self.words[at : at + 1].view(np.uint8), bitorder="little")
        return at * 64 + int(np.flatnonzero(bits)[rank - int(self.before[at])])


@dataclass(frozen=True)
class RunContainer:
    """Runs of neighbouring low halves: where each starts and the members before it."""

    starts: np.ndarray
    before: np.ndarray

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.starts[at]) + rank - int(self.before[at])


Container = ArrayContainer | BitmapContainer | RunContainer


def container(member: np.ndarray) -> Container:
    """The smallest layout of the low halves that ``member`` (at most ``SPAN`` booleans) marks."""
    edges = np.diff(member.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edges == 1)
    cardinality = int(np.count_nonzero(member))
    array_bytes, run_bytes = 2 * cardinality, 4 * len(starts)
    if run_bytes < min(array_bytes, _BITMAP_BYTES):
        lengths = np.flatnonzero(edges == -1) - starts
        return RunContainer(starts.astype(np.uint16), np.cumsum(lengths) - lengths)
    if array_bytes <= _BITMAP_BYTES:
        return ArrayContainer(np.flatnonzero(member).astype(np.uint16))
    return BitmapContainer.of(member)


class BoundarySet:
    """A set of offsets, given as one boolean for each offset from 0."""

    def __init__(self, member: np.ndarray) -> None:
        self.high: list[int] = []
        self.containers: list[Container] = []
        counts = []
        for high in range(-(-len(member) // SPAN)):
            part = member[high * SPAN : (high + 1) * SPAN]
            cardinality = int(np.count_nonzero(part))
            if cardinality:
                self.high.append(high)
                self.containers.append(container(part))
                counts.append(cardinality)
        self.cumulative = np.cumsum(counts, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.cumulative[-1]) if len(self.cumulative) else 0

    def select(self, rank: int) -> int:
        """The offset with ``rank`` smaller ones in the set."""
        if not 0 <= rank < len(self):
            raise IndexError(f"rank {rank} of a set of {len(self)}")
        at = int(np.searchsorted(self.cumulative, rank, side="right"))
        before = int(self.cumulative[at - 1]) if at else 0
        return self.high[at] * SPAN + self.containers[at].select(rank - before)


def token_boundaries(text: str) -> BoundarySet:
    """Where the tokens of a text start and end, in code points, its two ends included.

    A token is a run of A-Z and a-z, or any other single code point. So a boundary lies
    wherever not both neighbours are letters, and the set has one more member than the
    text has tokens.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = ((codes | 32) - np.uint32(97)) < 26
    member = np.ones(len(codes) + 1, dtype=bool)
    member[1:-1] = ~(letter[1:] & letter[:-1])
    return BoundarySet(member)
