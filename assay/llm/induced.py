"""Induced sorting of suffixes with common-prefix values, in external queues.

Suffixes that are smaller than their successor and follow a larger one (S*) are named by the text up to the next of them;
the string of names is sorted first, and all other suffixes follow from it in two sweeps over the first bytes.  Each byte
has a queue of (suffix, common prefix with the one before it in the queue); a sweep takes the queues in byte order, and
what it takes induces the suffixes one position to the left.  A queue is filled in sorted order, so first in, first out is
its priority.  Queues beyond the memory budget go to disk.  Common prefixes are counted up to ``cap`` bytes, and suffixes
that share ``cap`` bytes stand in no particular order.
"""

from __future__ import annotations

import tempfile

import numpy as np

# Never part of a UTF-8 text; ends each piece of the text to sort.
END = 0xFF

# Queued entries kept in memory.
MEMORY_ENTRIES = 32_000_000


class Queues:
    """One queue per byte of (position, common prefix) runs, in memory up to a budget and then in an unnamed file."""

    def __init__(self, memory_entries: int):
        self.room = memory_entries
        self.runs: list[list] = [[] for _ in range(256)]
        self.file = None

    def put(self, byte: int, at: np.ndarray, lcp: np.ndarray) -> None:
        if self.room >= len(at):
            self.room -= len(at)
            self.runs[byte].append((at, lcp))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        place = self.file.seek(0, 2)
        self.file.write(at.tobytes() + lcp.tobytes())
        self.runs[byte].append((place, len(at)))

    def take(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        """All that waits in a queue, in order; the queue is empty then."""
        found = []
        for a, b in self.runs[byte]:
            if isinstance(a, int):
                self.file.seek(a)
                raw = self.file.read(b * 6)
                found.append((np.frombuffer(raw, "<i4", b), np.frombuffer(raw, "<i2", b, b * 4)))
            else:
                self.room += len(a)
                found.append((a, b))
        self.runs[byte] = []
        if len(found) == 1:
            return found[0]
        return np.concatenate([f[0] for f in found] or [np.zeros(0, "<i4")]), np.concatenate([f[1] for f in found] or [np.zeros(0, "<i2")])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Sweep:
    """Common prefixes of induced suffixes: one more than the least between the suffixes that induce them."""

    def __init__(self, cap: int):
        self.cap = cap
        self.least = np.zeros(256, "<i2")  # since the last entry of each queue

    def split(self, targets: np.ndarray, use: np.ndarray, lcp: np.ndarray):
        """(byte, chosen rows, their common prefixes) for every byte among the used targets.

        ``lcp`` is each row's common prefix with the row swept before it.
        """
        if not len(lcp):
            return
        low, last = lcp.min(), np.zeros(256, bool)
        chosen = np.nonzero(use)[0]
        order = np.argsort(targets[chosen], kind="stable")
        chosen = chosen[order].astype("i8")
        kinds = targets[chosen]
        cuts = np.nonzero(np.diff(kinds))[0] + 1
        out = []
        for part in np.split(chosen, cuts) if len(chosen) else []:
            byte = int(targets[part[0]])
            starts = np.concatenate([[0], part[:-1] + 1])
            if part[-1] + 1 < len(lcp):
                mins = np.minimum.reduceat(lcp, np.append(starts, part[-1] + 1))
                after = mins[-1]
                mins = mins[:-1]
            else:
                mins, after = np.minimum.reduceat(lcp, starts), self.cap
            mins = mins.copy()
            mins[0] = min(mins[0], self.least[byte])
            self.least[byte] = after
            last[byte] = True
            out.append((byte, part, np.minimum(mins + 1, self.cap).astype("<i2")))
        self.least[~last] = np.minimum(self.least[~last], low)
        yield from out


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number, but for the last eight positions."""
    n = len(text) - 8
    out = np.zeros(n, "<u8")
    for k in range(8):
        out = (out << np.uint64(8)) | text[k : n + k]
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)  # equal keys get one rank in any order
    sorted_keys = keys[order]
    ranks = np.empty(len(keys), "i8")
    ranks[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
    return ranks


def _names(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Rank of the text from each start up to and including the next one's first byte; the last reaches past the end."""
    sizes = np.append(np.diff(starts) + 1, n - starts[-1] + 1)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)

    def word(rows: np.ndarray, k: int) -> np.ndarray:
        left = np.clip(sizes[rows] - 8 * k, 0, 8)
        filler = np.where(left >= 8, np.uint64(0), full >> np.minimum(8 * left, 63).astype("u8"))
        filler = np.where(left == 0, full, filler)
        return words[np.minimum(starts[rows] + 8 * k, len(words) - 1)] | filler

    everything = np.arange(len(starts))
    ranks = _dense(word(everything, 0))
    k = 1
    while (long := sizes > 8 * k).any():
        # Only names that some longer piece shares can split.
        rows = np.nonzero(np.isin(ranks, np.unique(ranks[long])))[0]
        inner = np.lexsort((word(rows, k), ranks[rows]))
        a, b = ranks[rows][inner], word(rows, k)[inner]
        new_name = np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        fine = np.empty(len(rows), "i8")
        fine[inner] = np.cumsum(new_name)
        wide = ranks * (len(rows) + 1)
        wide[rows] += fine
        ranks = _dense(wide)
        k += 1
    return ranks


def _sort_starred(n: int, words: np.ndarray, starts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order, and each one's common prefix (up to ``cap``) with the one before it.

    The string of names is sorted by doubling; two bytes at least belong to a name, which bounds the rounds.
    """
    m = len(starts)
    # A name's rank is the number of smaller ones, so that those that are alone in their rank stay as they are.
    dense = _names(words, starts, n)
    counts = np.bincount(dense)
    ranks = (np.cumsum(counts) - counts)[dense]
    rows = np.nonzero(counts[dense] > 1)[0]
    end = np.array([-1], "i4")  # behind the last name
    levels = [np.append(ranks.astype("i4"), end)]
    step = 1
    while step * 2 <= cap and len(levels) < 32 and len(rows):
        after = np.full(len(rows), -1, "i8")
        inside = rows + step < m
        after[inside] = ranks[rows[inside] + step]
        keys = ranks[rows] * (m + 1) + after + 1
        order = np.argsort(keys)
        rows, keys = rows[order], keys[order]
        old = ranks[rows]
        number = np.arange(len(rows))
        first_old = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), number, 0))
        fresh = np.append(True, keys[1:] != keys[:-1])
        ranks[rows] = old + np.maximum.accumulate(np.where(fresh, number, 0)) - first_old
        levels.append(np.append(ranks.astype("i4"), end))
        rows = rows[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    order = np.argsort(ranks)
    a, b = order[1:].copy(), order[:-1].copy()
    pairs = np.nonzero(levels[0][a] == levels[0][b])[0]
    x, y = a[pairs], b[pairs]
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][x] == levels[k][y]).astype("i8") << k
        x += same
        y += same
    a[pairs], b[pairs] = x, y
    ends = np.append(starts, n)
    shared = ends[np.minimum(a, m)] - starts[order[1:]]
    p, q = ends[np.minimum(a, m)], ends[np.minimum(b, m)]
    going = np.nonzero(shared < cap)[0]
    while len(going):
        x, y = p[going], q[going]
        here = (x < len(words)) & (y < len(words))
        going, x, y = going[here], x[here], y[here]
        differ = words[x] ^ words[y]
        same = np.zeros(len(going), "u1")
        for k in range(8):  # equal leading bytes
            same += differ < np.uint64(1 << (8 * k))
        shared[going] += same
        p[going] += same
        q[going] += same
        going = going[(same == 8) & (shared[going] < cap)]
    shared = np.minimum(shared, n - np.maximum(starts[order[1:]], starts[order[:-1]]))  # padding is no text
    return starts[order].astype("<i4"), np.concatenate([[0], np.minimum(shared, cap)]).astype("<i2")


def sorted_suffixes(text: np.ndarray, cap: int, memory_entries: int = MEMORY_ENTRIES):
    """Yield (positions, common prefixes) of all suffixes of ``text``, in runs of sorted suffixes with equal first byte.

    Each run is in ascending or descending order; a common prefix is the one with the position before it in the run.  The
    suffixes of a byte come in two runs, those larger than their successor and those smaller.  ``text`` is an array of bytes
    that ends with ``END``.
    """
    n = len(text)
    if not n:
        return
    padded = np.concatenate([text, np.zeros(16, "u1")])
    wide = text.astype("<i2")
    step = np.sign(np.diff(np.append(wide, -1)))  # of the next byte against this one
    places = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(places[::-1])[::-1]
    small = step[np.minimum(nearest, n - 1)] > 0  # S: smaller than the next suffix
    run = nearest + 1 - np.arange(n)  # equal bytes from here on
    del places, nearest, step
    before = np.concatenate([[0], text[:-1]]).astype("u1")
    starred = np.nonzero(small & np.concatenate([[False], ~small[:-1]]))[0]
    stars: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if len(starred):
        at, lcp = _sort_starred(n, _words(padded), starred, cap)
        cuts = np.nonzero(np.diff(text[at]))[0] + 1
        for x, y in zip(np.split(at, cuts), np.split(lcp, cuts)):
            stars[int(text[x[0]])] = (x, y)
    first = lambda lcp, value: np.concatenate([[value], lcp[1:]]).astype("<i2")

    # Up: larger-than-next suffixes, from those and the S* of all smaller bytes.
    queues, kept, sweep = Queues(memory_entries), Queues(memory_entries), _Sweep(cap)
    queues.put(int(text[-1]), np.array([n - 1], "<i4"), np.zeros(1, "<i2"))
    sweep.least[int(text[-1])] = 0
    for byte in range(256):
        tail = None
        while queues.runs[byte]:
            at, lcp = queues.take(byte)
            if tail is None:
                lcp = first(lcp, 0)
            kept.put(byte, at, lcp)
            tail = at[-1]
            prev = before[at]
            for target, rows, shared in sweep.split(prev, (at > 0) & (prev >= byte), lcp):
                queues.put(target, at[rows] - 1, shared)
        if byte in stars:
            at, lcp = stars[byte]
            lcp = first(lcp, 0 if tail is None else min(run[tail], run[at[0]], cap))
            prev = before[at]
            for target, rows, shared in sweep.split(prev, (at > 0) & (prev > byte), lcp):
                queues.put(target, at[rows] - 1, shared)
    queues.close()

    # Down: smaller-than-next suffixes, from those and the larger-than-next of all larger bytes.
    queues, sweep = Queues(memory_entries), _Sweep(cap)
    for byte in range(255, -1, -1):
        tail, found = None, []
        while queues.runs[byte]:
            at, lcp = queues.take(byte)
            if tail is None:
                lcp = first(lcp, 0)
            found.append((at, lcp))
            tail = at[-1]
            prev = before[at]
            for target, rows, shared in sweep.split(prev, (at > 0) & (prev <= byte), lcp):
                queues.put(target, at[rows] - 1, shared)
        if found:
            yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        at, lcp = kept.take(byte)
        if len(at):
            yield at, lcp
            # Backwards, a common prefix belongs to the larger of two neighbours.
            down, shared = at[::-1], np.concatenate([[0], lcp[:0:-1]]).astype("<i2")
            if tail is not None:
                shared[0] = min(run[tail], run[down[0]], cap)
            prev = before[down]
            for target, rows, new in sweep.split(prev, (down > 0) & (prev < byte), shared):
                queues.put(target, down[rows] - 1, new)
    queues.close()
    kept.close()


def repeated(text: np.ndarray, valid: np.ndarray, weight: np.ndarray, length: int, memory_entries: int = MEMORY_ENTRIES) -> np.ndarray:
    """Which valid positions start a ``length``-byte string whose valid starts weigh two or more together."""
    marked = np.zeros(len(text), bool)
    stops = np.append(np.nonzero(text[1:] != text[:-1])[0], len(text) - 1)
    runs = np.repeat(stops, np.diff(stops, prepend=-1)) + 1 - np.arange(len(text))  # equal bytes from here on
    even: dict[int, list[np.ndarray]] = {}  # strings of one byte alone stand in both runs of that byte
    for at, lcp in sorted_suffixes(text, length, memory_entries):
        group = np.cumsum(lcp < length)
        groups = np.bincount(group, np.where(valid[at], weight[at], 0))
        hit = at[valid[at] & (groups[group] >= 2)]
        marked[hit] = True
        uniform = at[valid[at]]
        uniform = uniform[runs[uniform] >= length]
        if len(uniform):
            even.setdefault(int(text[at[0]]), []).append(uniform)
    for parts in even.values():
        every = np.concatenate(parts)
        if weight[every].sum() >= 2:
            marked[every] = True
    return marked
