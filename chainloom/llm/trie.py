"""Double-array trie of pieces, and the lattice of pieces in a batch of segments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of a long segment whose edges are held at a time.
STRETCH = 1 << 15
#: Segments beyond so many bytes are worked out alone.
LONG = 1 << 13


class DoubleArray:
    """Double-array trie over bytes: the child of s by byte c is base[s] + c + 1 where check[] there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        self.longest = max(map(len, keys), default=1)
        root: dict = {}
        for key, value in zip(keys, values, strict=True):
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        base, check, leaf, taken = [0], [-1], [-1], bytearray(1)
        taken[0] = 1
        todo, hint = [(0, root)], 1
        while todo:
            state, node = todo.pop()
            leaf[state] = node.get(-1, -1)
            at = [c + 1 for c in sorted(c for c in node if c >= 0)]
            if not at:
                continue
            begin = max(0, hint - at[0])
            tries = 0
            while True:
                if begin + 260 > len(taken):
                    more = max(4096, begin + 260 - len(taken))
                    base += [0] * more
                    check += [-1] * more
                    leaf += [-1] * more
                    taken.extend(bytes(more))
                if not any(taken[begin + c] for c in at):
                    break
                begin += 1
                tries += 1
            if tries > 40:  # what lies below is nearly full
                hint += tries // 2
            base[state] = begin
            for c in at:
                taken[begin + c] = 1
                check[begin + c] = state
            todo += [(begin + c, node[c - 1]) for c in at]
        base, check, leaf = (np.array(x, dtype=np.int32) for x in (base, check, leaf))
        taken = np.frombuffer(bytes(taken), dtype=np.uint8)
        top = int(np.flatnonzero(taken)[-1]) + 300
        self.base, self.check, self.leaf = (np.concatenate([x[:top], np.full(300, fill, x.dtype)]) for x, fill in ((base, 0), (check, -1), (leaf, -1)))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none."""
        to = self.base[state] + byte + 1
        return np.where(self.check[to] == state, to, -1)


@dataclass
class Lattice:
    """Pieces that occur in a batch of UTF-8 segments; a segment of n bytes has n + 1 nodes."""

    flat: np.ndarray  # bytes of all segments
    heads: np.ndarray  # where characters begin
    lengths: np.ndarray
    first: np.ndarray  # first byte of each segment
    row: np.ndarray  # segment of each byte
    begin: np.ndarray  # of each edge: first byte, byte after the last, piece id or -1 for a lone character
    end: np.ndarray
    piece: np.ndarray


def lattice(trie: DoubleArray, data: list[bytes]) -> Lattice:
    """All pieces of the batch, one trie step for all starts at a time; characters that are no piece get an edge -1."""
    lengths = np.array([len(d) for d in data])
    flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int32)
    first = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(data)), lengths)
    stop = (first + lengths)[row]
    heads = np.flatnonzero((flat & 0xC0) != 0x80)
    lead = flat[heads]
    wide = np.zeros(len(flat), dtype=np.int64)
    wide[heads] = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    single = np.zeros(len(flat), dtype=bool)
    pos, state, depth = heads, np.zeros(len(heads), dtype=np.int32), 0
    begins, ends, ids = [], [], []
    while len(pos):
        state = trie.step(state, flat[pos + depth])
        depth += 1
        live = state >= 0
        pos, state = pos[live], state[live]
        piece = trie.leaf[state]
        hit = piece >= 0
        begins.append(pos[hit])
        ends.append(pos[hit] + depth)
        ids.append(piece[hit])
        single[pos[hit & (wide[pos] == depth)]] = True
        more = pos + depth < stop[pos]
        pos, state = pos[more], state[more]
    alone = heads[~single[heads]]
    begins.append(alone)
    ends.append(alone + wide[alone])
    ids.append(np.full(len(alone), -1, dtype=np.int32))
    return Lattice(flat, heads, lengths, first, row, np.concatenate(begins), np.concatenate(ends), np.concatenate(ids))


def stretches(trie: DoubleArray, data: bytes, size: int = 0) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """(begins, ends, pieces) of the edges of one long segment, by their begin, in stretches of about `size` bytes: only one stretch is held."""
    size, at = size or STRETCH, 0
    while at < len(data):
        to = min(len(data), at + size)
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to += 1
        found = lattice(trie, [data[at : to + max(4, trie.longest)]])
        mine = np.flatnonzero(found.begin < to - at)
        mine = mine[np.argsort(found.begin[mine], kind="stable")]
        yield (found.begin[mine] + at).tolist(), (found.end[mine] + at).tolist(), found.piece[mine].tolist()
        at = to


def alone(data: list[bytes]) -> bool:
    """Whether segments of a batch go through stretches() one by one: they are few, so steps over all at a time gain nothing, or long."""
    return len(data) <= 4 or len(data[-1]) > LONG


def like_lengths(texts: list[str], most: int = 1 << 17) -> Iterator[tuple[list[int], list[bytes]]]:
    """Batches of (indexes, UTF-8) of segments of like length, near `most` bytes each."""
    data = [t.encode("utf-8", "replace") for t in texts]
    held, total = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(data[i])):
        if held and total + len(data[i]) > most:
            yield held, [data[k] for k in held]
            held, total = [], 0
        held.append(i)
        total += len(data[i])
    if held:
        yield held, [data[k] for k in held]


def by_offset(offset: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Stable order of offsets within segments, and the (low, high) range of each value in that order."""
    narrow = offset.astype(np.uint16) if not len(offset) or offset.max() < 1 << 16 else offset  # 16 bits are sorted by radix
    rank = np.argsort(narrow, kind="stable")
    ranked = narrow[rank]
    bounds = [0, *(np.flatnonzero(ranked[1:] != ranked[:-1]) + 1).tolist(), len(rank)]
    return rank, list(zip(bounds[:-1], bounds[1:], strict=True))
