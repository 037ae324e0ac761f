"""Set comparisons within one task, for the n-gram Jaccard join.

Nothing here emits a pair: each function joins up members whose sets may link (or do)
and returns a label for each member, the least place of a member it is joined to.
"""

from __future__ import annotations

import numpy as np

from .components import least_labels

#: Pairs that are looked at together.
CHUNK = 1 << 16


def sketch_words(n: int) -> int:
    """64-bit words of the parity sketch of a set of n: about a bit a member, a power of two."""
    return 1 << max(0, (max(n, 1) - 1).bit_length() - 6)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the members by the low bits of their hashes. The bits in which two sketches differ cannot outnumber the members that only one set has."""
    bits = 64 * sketch_words(len(s))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


class Sketches:
    """Sketches of several sets in one array; compared at the smaller of two sizes, the larger being folded."""

    def __init__(self, each: list[bytes]):
        self.words = np.array([len(x) // 8 for x in each], np.int64)
        self.at = np.cumsum(self.words) - self.words
        self.data = np.frombuffer(b"".join(each), np.uint64)

    def _folded(self, i: np.ndarray, w: int) -> np.ndarray:
        out = np.zeros((len(i), w), np.uint64)
        for size in np.unique(self.words[i]):
            j = np.flatnonzero(self.words[i] == size)
            for part in range(0, size, w):
                out[j] ^= self.data[(self.at[i[j]] + part)[:, None] + np.arange(w)]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Members that only one of the sets a and b has, at least."""
        out = np.zeros(len(a), np.int64)
        least = np.minimum(self.words[a], self.words[b])
        for w in np.unique(least):
            j = np.flatnonzero(least == w)
            out[j] = np.bitwise_count(self._folded(a[j], w) ^ self._folded(b[j], w)).sum(axis=1)
        return out


def _fits(na, nb, pa, pb, percent: int) -> np.ndarray:
    """Whether sizes and the places of a shared shingle allow a link."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * small >= percent * large) & ((100 + percent) * (np.minimum(pa, pb) + np.minimum(na - pa, nb - pb)) >= percent * (na + nb))


def candidates(token: np.ndarray, who: np.ndarray, n: np.ndarray, pos: np.ndarray, right: np.ndarray | None, sketches: Sketches, label: np.ndarray, percent: int) -> np.ndarray:
    """Labels of members joined by pairs that share a list and that size, place and sketch allow to link.

    Rows stand list by list, in order of size; ``who``: member of each row; ``right``: rows
    of the second of two blocks of one list (then only pairs across count). Members that
    are joined up already are not compared again.
    """
    begin = np.flatnonzero(np.diff(token, prepend=token[:1] - 1))
    end = np.append(begin[1:], len(token))
    of = np.repeat(np.arange(len(begin)), end - begin)
    end = end[of]
    row = np.arange(len(token))
    step, held = 0, []

    def settle() -> None:
        nonlocal label, held
        if held:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            key = np.unique(np.minimum(a, b) * len(label) + np.maximum(a, b))
            a, b = key // len(label), key % len(label)
            for i in range(0, len(a), CHUNK):
                x, y = a[i : i + CHUNK], b[i : i + CHUNK]
                new = label[x] != label[y]
                x, y = x[new], y[new]
                # link if |A & B| >= p (|A| + |B|) / (100 + p), that is |A ^ B| <= (100 - p) (|A| + |B|) / (100 + p)
                ok = (100 + percent) * sketches.apart(x, y) <= (100 - percent) * (size[x] + size[y])
                label = least_labels(x[ok], y[ok], label)
        held = []

    size = np.zeros(len(label), np.int64)
    size[who] = n
    n = n.astype(np.int64)
    waiting = 0
    while True:
        step += 1
        row = row[row + step < end[row]]
        # rows are in order of size within a list: too far apart once, too far apart for good
        row = row[100 * n[row] >= percent * n[row + step]]
        if not len(row):
            break
        i, j = row, row + step
        if right is not None:
            cross = right[i] != right[j]
            i, j = i[cross], j[cross]
        new = label[who[i]] != label[who[j]]
        i, j = i[new], j[new]
        ok = _fits(n[i], n[j], pos[i], pos[j], percent)
        held.append((who[i[ok]], who[j[ok]]))
        waiting += int(ok.sum())
        if waiting >= CHUNK or step & (step - 1) == 0:
            settle()
            waiting = 0
            least, most = np.minimum.reduceat(label[who], begin), np.maximum.reduceat(label[who], begin)
            row = row[(least != most)[of[row]]]
    settle()
    return label


def _gather(start: np.ndarray, owners: np.ndarray, tokens: np.ndarray, m: int) -> np.ndarray:
    """How many of the lists of ``tokens`` hold each member."""
    size = start[tokens + 1] - start[tokens]
    total = int(size.sum())
    at = np.repeat(start[tokens] - (np.cumsum(size) - size), size) + np.arange(total)
    return np.bincount(owners[at], minlength=m)


def answers(sets: list[np.ndarray], right: np.ndarray | None, label: np.ndarray, percent: int) -> np.ndarray:
    """Labels of members joined by exact links among ``sets`` (sorted distinct members; across the two sides only, where ``right`` tells them apart).

    An inverted index over all sets gives a set's overlaps with all others: its answer. A
    set that shares most members with the one before has its answer derived from that
    one's: only the lists of members that one of the two has are read. Sets whose possible
    partners are all joined up with it already need no answer.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if label[0] != label[1] and 100 * inter >= percent * (n.sum() - inter):
            label = np.minimum(label, label.min())
        return label
    every = np.concatenate(sets)
    _, local, count = np.unique(every, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), n)
    shared = count > 1
    number = np.cumsum(shared) - shared
    mine = shared[local]
    local, owner = number[local[mine]], owner[mine]
    first = np.searchsorted(owner, np.arange(m + 1))
    by = np.argsort(local, kind="stable")
    start = np.searchsorted(local[by], np.arange(int(shared.sum()) + 1))
    owners = owner[by]
    # sets that share their least members stand next to each other
    lead = np.stack([local[first[:-1].clip(max=max(len(local) - 1, 0))], local[(first[:-1] + 1).clip(max=max(len(local) - 1, 0))]]) if len(local) else np.zeros((2, m), np.int64)
    order = np.lexsort((n, lead[1], lead[0]))
    if right is not None:  # the smaller side asks
        side = right if right.sum() * 2 <= m else ~right
        order = order[side[order]]
    before, held = None, None
    length = start[1:] - start[:-1]
    for x in order:
        open_ = (label != label[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if right is not None:
            open_ &= right != right[x]
        if not open_.any():
            continue
        own = local[first[x] : first[x + 1]]
        if before is not None:
            plus, minus = np.setdiff1d(own, before, assume_unique=True), np.setdiff1d(before, own, assume_unique=True)
        if before is not None and length[plus].sum() + length[minus].sum() < length[own].sum():
            held = held + _gather(start, owners, plus, m) - _gather(start, owners, minus, m)
        else:
            held = _gather(start, owners, own, m)
        before = own
        hit = open_ & (100 * held >= percent * (n + n[x] - held))
        if hit.any():
            joined = np.unique(np.append(label[hit], label[x]))
            label = np.where(np.isin(label, joined), joined[0], label)
    return label
