"""Suffix sorting of one shard by external induced sorting, with common prefixes.

Suffixes that begin a rising run after a falling one (seeds) are sorted first, by ranking the strings from seed to
seed and sorting the string of their ranks the same way, recursively, until it fits in memory. From the seeds, a
pass in rising order induces the falling suffixes and a pass in falling order the rising ones. Each pass takes tuples of
key, place and common prefix from a priority queue whose buckets go to disk when too many tuples are held, and works on
batches: as many tuples as can go before the first of the tuples that they induce.

The common prefix of a tuple is that with the tuple before it, in symbols and up to a cap. What a tuple induces has one symbol
more in common with the tuple that was induced last with the same symbol than all that was taken in between had with what
was taken before; the least of those is kept for each symbol from batch to batch. Seeds bring theirs from the string of names.

Where only some suffixes are asked for, only these and those from which they are induced go through the queues: what stands between
a suffix and the next seed, and that seed, on each level of the recursion. Names are given to the whole text.
"""

from __future__ import annotations

import tempfile

import numpy as np

_LAST = np.int64(1) << 46
_FEW = 32
#: Queues hold such a part of ``memory``, as about such a part of a shard's suffixes start a string and are sorted.
_QUEUES = 4
_SHORT = 1 << 14


def _sorting(keys: np.ndarray) -> np.ndarray:
    """The order of keys that are not negative, that of arrival among equal ones. Where key and place fit in one number, these
    numbers are sorted, which takes a fraction of sorting places by their keys."""
    n = len(keys)
    bits = n.bit_length()
    if not n or int(keys.max()) >> 63 - bits:
        return np.argsort(keys, kind="stable")
    return np.sort(keys.astype(np.int64) << bits | np.arange(n)) & (1 << bits) - 1


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether each value, the first aside, differs from the one before it; the first always does."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


class DiskQueue:
    """Tuples (key, place, common prefix) in the order of keys, and of arrival among equal keys; keys only grow past what was
    taken. Buckets come in two tiers: what lies far ahead is only told apart by coarse ones."""

    def __init__(self, keys: int, memory: int):
        self.shift = max(0, int(keys).bit_length() - 10)
        self.size = (int(keys) >> self.shift) + 1
        self.coarse: list[list] = [[] for _ in range(self.size // _FEW + 1)]
        self.fine: list[list] = []
        self.now = -1
        self.memory, self.held, self.file = memory, 0, None

    @staticmethod
    def _split(rows: np.ndarray, bucket: np.ndarray, into: list[list], first: int) -> None:
        if bucket[0] == bucket[-1] and (bucket == bucket[0]).all():
            into[int(bucket[0]) - first].append(rows)
            return
        order = np.argsort(bucket.astype(np.int16), kind="stable")
        bucket, rows = bucket[order], rows[order]
        edges = np.flatnonzero(_changes(bucket)).tolist()
        for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
            into[int(bucket[a]) - first].append(rows[a:b])

    def push(self, key: np.ndarray, place: np.ndarray, prefix: np.ndarray) -> None:
        if not len(key):
            return
        rows = np.empty((len(key), 2), np.int64)
        rows[:, 0], rows[:, 1] = key << 16 | prefix, place
        bucket = key >> self.shift
        coarse = bucket // _FEW
        near = coarse == self.now
        if near.all():
            self._split(rows, bucket, self.fine, self.now * _FEW)
        else:
            if near.any():
                self._split(rows[near], bucket[near], self.fine, self.now * _FEW)
                rows, coarse = rows[~near], coarse[~near]
            self._split(rows, coarse, self.coarse, 0)
        self.held += len(key)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for parts in (*self.coarse, *self.fine):
            for k, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    self.file.write(part.tobytes())
                    parts[k] = (at, len(part))
                    at += part.nbytes
        self.held = 0

    def _take(self, parts: list) -> np.ndarray:
        rows = []
        for part in parts:
            if isinstance(part, np.ndarray):
                self.held -= len(part)
            else:
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(16 * part[1]), np.int64).reshape(-1, 2)
            rows.append(part)
        parts.clear()
        return np.concatenate(rows) if rows else np.zeros((0, 2), np.int64)

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if bucket // _FEW != self.now:
            self.now = bucket // _FEW
            rows = self._take(self.coarse[self.now])
            self.fine = [[] for _ in range(_FEW)]
            if len(rows):
                self._split(rows, rows[:, 0] >> 16 + self.shift, self.fine, self.now * _FEW)
                self.held += len(rows)
        rows = self._take(self.fine[bucket % _FEW])
        return rows[:, 0] >> 16, rows[:, 1], rows[:, 0] & 0xFFFF

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Prefixes:
    """Common prefixes of what a pass induces."""

    def __init__(self, symbols: int, cap: int):
        self.cap = cap
        self.low = np.zeros(symbols, np.int32)  # since the last tuple induced with a symbol, to the end of its batch
        self.stamp = np.full(symbols, -2, np.int32)  # which batch that was
        self.batch = 0
        self.when: list[int] = []  # batches whose least is less than that of all later ones, and that least
        self.least: list[int] = []

    def induced(self, prefix: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Those of the tuples that the tuples at these places of a batch induce, with these symbols."""
        cap = self.cap
        ahead = np.minimum.accumulate(prefix)
        out = np.zeros(len(at), np.int64)
        if len(at):
            behind = np.full(len(prefix) + 1, cap, np.int64)
            behind[:-1] = np.minimum.accumulate(prefix[::-1])[::-1]
            order = _sorting(symbol)
            s, i = symbol[order], at[order]
            first = _changes(s)
            again = ~first[1:]
            found = np.zeros(len(at), np.int64)
            if again.any():
                found[1:][again] = 1 + _range_least(prefix, i[:-1][again] + 1, i[1:][again])
            c = s[first]
            stamp = self.stamp[c]
            since = np.minimum(self.low[c], ahead[i[first]])
            if self.when:
                later = np.searchsorted(self.when, stamp + 1)
                least = np.append(self.least, cap)[later]
                since = np.minimum(since, least)
            found[first] = np.where(stamp < 0, 0, 1 + since)
            last = np.append(first[1:], True)
            self.low[s[last]] = behind[i[last] + 1]
            self.stamp[s[last]] = self.batch
            out[order] = np.minimum(found, cap)
        least = int(ahead[-1])
        while self.least and self.least[-1] >= least:
            self.least.pop()
            self.when.pop()
        self.least.append(least)
        self.when.append(self.batch)
        self.batch += 1
        return out


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value from each first to each last place."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), np.int64)
    table = values.astype(np.int16 if values.max(initial=0) < 1 << 15 else np.int64)
    if len(values) <= _SHORT:  # the tables of all levels at once
        tables = np.empty((int(level.max()) + 1, len(table)), table.dtype)
        tables[0] = table
        for k in range(1, len(tables)):
            half = 1 << k - 1
            np.minimum(tables[k - 1, :-half], tables[k - 1, half:], out=tables[k, :-half])
        return np.minimum(tables[level, first], tables[level, last - (1 << level.astype(np.int64)) + 1])
    for k in range(int(level.max()) + 1):
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[first[mine]], table[last[mine] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _induce(
    text: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, top: int, up: bool, memory: int, known: np.ndarray | None = None, run: np.ndarray | None = None, cap: int = 0,
) -> tuple[np.ndarray, np.ndarray | None]:
    """The wanted suffixes, which are falling ones in rising order (up) or rising ones in falling order, induced from sorted seeds;
    if the common prefixes of the seeds are known, with theirs."""
    def keys(place: np.ndarray) -> np.ndarray:
        symbol = text[place].astype(np.int64)
        return 2 * symbol if up else 2 * (top - symbol)

    queue = DiskQueue(2 * top + 2, memory)
    carry = Prefixes(top + 1, cap) if known is not None else None
    queue.push(keys(seeds) + 1, seeds, known if carry else np.zeros(len(seeds), np.int64))
    out, shared = [], []
    last = (-2, 0)
    for bucket in range(queue.size):
        key, place, prefix = queue.pop(bucket)
        while len(key):
            if (key[1:] < key[:-1]).any():
                order = _sorting(key)
                key, place, prefix = key[order], place[order], prefix[order]
            before = place - 1
            induces = wanted[before] & (place > 0)
            new = np.where(induces, keys(before), _LAST)
            n = len(key)
            if new.min() < key[-1]:
                late = key[1:] > np.minimum.accumulate(new)[:-1]
                n = int(np.argmax(late)) + 1 if late.any() else n
            took, at, here = key[:n], place[:n], prefix[:n]
            own = took & 1 == 0
            chosen = np.flatnonzero(induces[:n])
            new, before = new[chosen], before[chosen]
            if carry:
                # a seed after what was induced with its symbol: as far as both go on with the symbol
                met = ~own
                met[0] &= took[0] - last[0] == 1
                met[1:] &= took[1:] - took[:-1] == 1
                if met.any():
                    other = np.append(last[1], at[:-1])[met]
                    here[met] = np.minimum(np.minimum(run[at[met]], run[other]), cap)
                last = (int(took[-1]), int(at[-1]))
                shared.append(here[own])
                more = carry.induced(here, chosen, new >> 1)
            else:
                more = np.zeros(len(new), np.int64)
            out.append(at[own])
            near = new >> queue.shift == bucket
            key, place, prefix = key[n:], place[n:], prefix[n:]
            if near.any():
                key = np.concatenate([key, new[near]])
                place = np.concatenate([place, before[near]])
                prefix = np.concatenate([prefix, more[near]])
                far = ~near
                new, before, more = new[far], before[far], more[far]
            queue.push(new, before, more)
    queue.close()
    nothing = np.zeros(0, np.int64)
    return np.concatenate(out) if out else nothing, (np.concatenate(shared) if shared else nothing) if carry else None


def _double(names: np.ndarray) -> np.ndarray:
    """The order of suffixes of a string that fits in memory: ranks by ever longer beginnings."""
    n, reach, rank = len(names), 1, names
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - reach] = rank[reach:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        reach *= 2


def _agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, done: np.ndarray, cap: int) -> np.ndarray:
    """How many symbols from a and b on agree, beyond ``done`` of them that do, up to ``cap`` in all."""
    done = np.minimum(done, cap)
    rows = np.flatnonzero(done < cap)
    a, b = a[rows] + done[rows], b[rows] + done[rows]
    while len(rows):
        on = text[a] == text[b]
        rows, a, b = rows[on], a[on] + 1, b[on] + 1
        done[rows] += 1
        on = done[rows] < cap
        if not on.all():
            rows, a, b = rows[on], a[on], b[on]
    return done


def _names(text: np.ndarray, rising: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The rank of the string from each seed to the next, both included; of equal symbols, one that falls comes first.

    With that rule no string is the beginning of another. Some symbols at a time are packed in one number, and only strings
    that are still tied and go on are looked at again.
    """
    width = int(text.max()).bit_length() + 1
    each = max(1, 63 // width)
    ends = np.append(seeds[1:] + 1, len(text))
    rank = np.zeros(len(seeds), np.int64)
    rows, done = np.arange(len(seeds)), 0
    while len(rows):
        packed = np.zeros(len(rows), np.int64)
        for k in range(each):
            at = seeds[rows] + done + k
            inside = at < ends[rows]
            at = np.minimum(at, len(text) - 1)
            packed = packed << width | np.where(inside, 2 * text[at].astype(np.int64) + rising[at], 0)
        done += each
        order = np.lexsort((packed, rank[rows])) if done > each else np.argsort(packed)
        r, p = rank[rows][order], packed[order]
        new = np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1]))
        at = np.flatnonzero(new)
        tied = np.repeat(np.diff(np.append(at, len(r))) > 1, np.diff(np.append(at, len(r))))
        # ranks are places in the order of all: the first place of the old rank, and how many come before inside it
        first = np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1]), np.arange(len(r)), 0))
        rank[rows[order]] = r + np.maximum.accumulate(np.where(new, np.arange(len(r)), 0)) - first
        again = rows[order][tied]
        rows = np.sort(again[seeds[again] + done < ends[again]])
    used = np.zeros(len(rank), bool)
    used[rank] = True
    return (np.cumsum(used) - 1)[rank]


def _chosen(order: np.ndarray, shared: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the sorted suffixes that are wanted, and what each has in common with the one before it among them."""
    at = np.flatnonzero(wanted[order])
    if len(at) in (0, len(order)):
        return order[at], shared[at]
    least = np.minimum.reduceat(shared[: at[-1] + 1], np.append(0, at[:-1] + 1))
    least[0] = 0
    return order[at], least


def _needed(wanted: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The places from each wanted one to the next seed, that seed left out: from there they are induced."""
    marks = np.cumsum(wanted, dtype=np.int32)
    before = np.append(0, marks[seeds - 1])  # how many are wanted before each stretch between seeds
    return marks > np.repeat(before, np.diff(np.concatenate([[0], seeds, [len(wanted)]])))


def suffix_order(
    text: np.ndarray, memory: int = 1 << 21, cap: int = 0, wanted: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Start places of all suffixes of ``text``, or of the wanted ones, in sorted order, and of each the common prefix with the one
    before it, up to ``cap``; the last number of the text must be the only least one."""
    n = len(text)
    if wanted is None:
        wanted = np.ones(n, bool)
    if n < 3:
        return _chosen(np.argsort(text, kind="stable"), np.zeros(n, np.int64), wanted)
    step = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    # equal neighbours are of the type of the next that differ
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    rising = np.ones(n, bool)
    rising[:-1] = step[np.minimum(at, n - 2)] > 0
    run = np.ones(n, np.int32)
    run[:-1] = np.minimum(at - np.arange(n - 1) + 1, cap)
    del step, at
    seeds = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    top = int(text.max())
    needed = _needed(wanted, seeds)
    used = needed[seeds - 1]  # seeds that something is induced from

    name = _names(text, rising, seeds)
    if int(name.max()) + 1 < len(seeds) and len(name) > memory:
        order, known = suffix_order(name, memory, cap, used)
    else:
        order = _double(name) if int(name.max()) + 1 < len(seeds) else np.argsort(name)
        order = order[used[order]]
        known = np.zeros(len(order), np.int64)  # names that a seed has in common with the one before it in the order
        known[1:] = _agree(name, order[:-1], order[1:], known[1:], cap)
    sorted_seeds = seeds[order]
    if not cap:
        known = None
    else:  # in symbols: whole strings between seeds, and what the next ones have in common
        a, b = order[:-1], order[1:]
        whole = seeds[np.minimum(a + known[1:], len(seeds) - 1)] - seeds[a]
        known[1:] = _agree(text, seeds[a], seeds[b], whole, cap)
    falling, of_falling = _induce(text, ~rising & needed, sorted_seeds, top, True, memory // _QUEUES, known, run, cap)
    back = np.append(0, of_falling[:0:-1]) if cap else None
    risen, of_risen = _induce(text, rising & needed, falling[::-1], top, False, memory // _QUEUES, back, run, cap)
    risen = risen[::-1]
    both = np.concatenate([[n - 1], falling, risen])
    order = _sorting(2 * text[both].astype(np.int64) + rising[both])
    shared = np.zeros(len(both), np.int64)
    if cap:
        shared = np.concatenate([[0], of_falling, np.zeros(min(len(risen), 1), np.int64), of_risen[:0:-1]])[order]
        order = both[order]
        meet = np.flatnonzero((text[order[1:]] == text[order[:-1]]) & rising[order[1:]] & ~rising[order[:-1]]) + 1
        shared[meet] = np.minimum(run[order[meet]], run[order[meet - 1]])
        return _chosen(order, shared, wanted)
    return _chosen(both[order], shared, wanted)


def repeated_starts(pieces: list[bytes], length: int, memory: int = 1 << 21) -> list[np.ndarray]:
    """For each piece, the starts of its strings of ``length`` bytes that start anywhere else too, in any piece."""
    sizes = np.array([len(p) + 1 for p in pieces])
    text = np.zeros(int(sizes.sum()) + 1, np.int16)
    text[:-1] = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + 2
    ends = np.cumsum(sizes) - 1
    text[ends] = 1
    starts = ends - sizes + 1
    left = np.append(np.repeat(ends, sizes) - np.arange(len(text) - 1), 0)
    # what agrees beyond the end of a piece goes on with the signs between pieces, and is no string of one
    order, shared = suffix_order(text, memory, length, left >= length)
    found = np.zeros(len(text), bool)
    same = np.flatnonzero(shared[1:] >= length)
    found[order[same]] = True
    found[order[same + 1]] = True
    return [np.flatnonzero(found[a:b]) for a, b in zip(starts, ends, strict=True)]
