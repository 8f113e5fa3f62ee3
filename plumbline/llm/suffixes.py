"""External induced sorting of the suffixes of a file, with common-prefix values.

Everything that is as long as the text lies in files: the text, the types of its
suffixes, the LMS suffixes (smaller than their follower, which their predecessor is
not), names, orders and runs. Memory holds pieces of CHUNK entries and a queue's
budget, whatever the length of the text.

Recursion. A first induction sorts the LMS substrings, which gives them names;
where names repeat, the string of names is sorted the same way: its LMS
substrings are induced, named and, if names still repeat, sorted by recursion; a
second induction then yields its whole order. The order of a string of names is the
order of the LMS suffixes one level above.

Queues. Suffixes wait in a monotone priority queue by (symbol, type), first come
first served: a suffix is induced in the order of its follower. Keys are dealt to
buckets by range; a bucket whose turn it is is dealt out again while it is large and has
several keys; buckets go to disk beyond the budget. A bucket of several keys (names
have a large alphabet) is taken as a whole, with all that is induced
within it.

Common prefixes. The last induction, over bytes, carries (position, common prefix
with the suffix before) tuples: those of LMS neighbours are compared directly, all
others are induced, being one byte more than the least common prefix passed since
the queue last received a suffix. Values are cut at `limit`.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np

CHUNK = 1 << 16
MEMORY_BYTES = 4 << 20
#: Most buckets of a queue level, entries of a bucket that is dealt out again, longest chain that is sorted as a whole, entries looked at together where chains are longer, and length of a string that is sorted in memory.
FAN, LOAD, WAVES, AHEAD, BASE = 512, 1 << 16, 1 << 11, 1 << 10, 1 << 15


def whole(most: int) -> np.dtype:
    """The smallest type on disk for numbers up to `most`."""
    return np.dtype(np.uint32 if most < 1 << 32 else np.int64)


def tuples(n: int, limit: int) -> np.dtype:
    """(position, common prefix) on disk."""
    return np.dtype([("at", whole(n)), ("lcp", np.int16 if limit < 1 << 15 else np.int64)])


class Run:
    """Entries appended to a file and read again in pieces; behind the first `first` entries of a file, which belong to other runs that are complete."""

    def __init__(self, path: str, dtype: np.dtype, first: int = 0):
        self.path, self.dtype, self.n, self.first = path, np.dtype(dtype), 0, first
        self.parts: list[np.ndarray] = []
        self.held = 0

    def append(self, part: np.ndarray) -> None:
        if len(part):
            self.parts.append(part)
            self.n += len(part)
            self.held += len(part)
            if self.held >= CHUNK:
                self.flush()

    def flush(self) -> Run:
        if self.parts:
            with open(self.path, "ab") as f:
                for p in self.parts:
                    f.write(np.ascontiguousarray(p, dtype=self.dtype).tobytes())
            self.parts, self.held = [], 0
        return self

    def load(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, self.dtype if self.dtype.names else np.int64)
        self.flush()
        got = np.fromfile(self.path, dtype=self.dtype, count=stop - start, offset=(self.first + start) * self.dtype.itemsize)
        return got if self.dtype.names else got.astype(np.int64)

    def chunks(self) -> Iterator[np.ndarray]:
        for at in range(0, self.n, CHUNK):
            yield self.load(at, min(at + CHUNK, self.n))

    def backwards(self) -> Iterator[np.ndarray]:
        for stop in range(self.n, 0, -CHUNK):
            yield self.load(max(0, stop - CHUNK), stop)[::-1]

    def view(self) -> np.ndarray:
        """The file as an array that the system pages in and out."""
        self.flush()
        return np.asarray(np.memmap(self.path, dtype=self.dtype, mode="r")) if self.n else np.zeros(0, self.dtype)

    def drop(self) -> None:
        self.parts = []
        if os.path.exists(self.path):
            os.remove(self.path)


# ---------------------------------------------------------------- queues


class _Level:
    """A range of keys dealt to buckets."""

    def __init__(self, base: int, keys: int, fan: int):
        fan = min(keys, FAN, max(2, fan))
        self.base, self.width, self.turn, self.fan = base, -(-keys // fan), 0, fan
        self.end = base + keys
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(fan)]
        self.count, self.written, self.read = ([0] * fan for _ in range(3))


class Queue:
    """External monotone priority queue: the least key first, equal keys first come first served; no key may come in below the last that went out."""

    def __init__(self, folder: str, keys: int, n: int, memory: int = MEMORY_BYTES, fan: int = 0):
        self.folder, self.memory = tempfile.mkdtemp(dir=folder), memory
        self.pair = np.dtype([("key", whole(keys)), ("at", whole(n))])
        self.levels = [_Level(0, keys, fan or (keys if keys <= FAN else 4 * n // LOAD))]
        self.held = self.spills = 0
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_fresh = 0
        self.keys = self.at = np.zeros(0, dtype=np.int64)  # the open bucket, sorted
        self.stop, self.fresh_bucket = 0, False

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def push(self, keys: np.ndarray, at: np.ndarray) -> None:
        if not len(keys):
            return
        own = keys < self.stop
        if own.any():
            order = np.argsort(keys[own], kind="stable")
            k, a = keys[own][order], at[own][order]
            place = np.searchsorted(self.keys, k, side="right")
            self.keys, self.at = np.insert(self.keys, place, k), np.insert(self.at, place, a)
            keys, at = keys[~own], at[~own]
        if len(keys):
            self.fresh.append((keys, at))
            self.n_fresh += len(keys)
            if self.n_fresh > CHUNK:
                self._deal()

    def _deal(self) -> None:
        """Deal what was pushed to the buckets, the deepest level first."""
        if not self.n_fresh:
            return
        keys, at = (np.concatenate(x) for x in zip(*self.fresh))
        self.fresh, self.n_fresh = [], 0
        for level in reversed(self.levels):
            own = keys < level.end
            if not own.any():
                continue
            rest = ~own
            index = (keys[own] - level.base) // level.width
            order = np.argsort(index.astype(np.uint16), kind="stable")  # few bits: a radix sort
            k, a, index = keys[own][order], at[own][order], index[order]
            edges = [0, *(np.flatnonzero(index[1:] != index[:-1]) + 1).tolist(), len(index)]
            for i, j, b in zip(edges, edges[1:], index[edges[:-1]].tolist()):
                level.parts[b].append((k[i:j], a[i:j]))
                level.count[b] += j - i
            self.held += 16 * len(k)
            keys, at = keys[rest], at[rest]
            if not len(keys):
                break
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for n, level in enumerate(self.levels):
            for b, parts in enumerate(level.parts):
                if parts:
                    with open(f"{self.folder}/{n}-{level.base}-{b}", "ab") as f:
                        for k, a in parts:
                            entry = np.empty(len(k), dtype=self.pair)
                            entry["key"], entry["at"] = k, a
                            f.write(entry.tobytes())
                            level.written[b] += len(k)
                    level.parts[b] = []
        self.held = 0
        self.spills += 1

    def _pop(self, level: _Level, b: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first entries of a bucket; what is on disk came before what is in memory."""
        left = level.written[b] - level.read[b]
        if left:
            got = np.fromfile(f"{self.folder}/{self.levels.index(level)}-{level.base}-{b}", dtype=self.pair, count=min(left, most), offset=self.pair.itemsize * level.read[b])
            level.read[b] += len(got)
            level.count[b] -= len(got)
            if left <= most:
                os.remove(f"{self.folder}/{self.levels.index(level)}-{level.base}-{b}")
                level.written[b] = level.read[b] = 0
            return got["key"].astype(np.int64), got["at"].astype(np.int64)
        n = size = 0
        parts = level.parts[b]
        while n < len(parts) and (not n or size + len(parts[n][0]) <= most):
            size += len(parts[n][0])
            n += 1
        k, a = parts[0] if n == 1 else (np.concatenate(x) for x in zip(*parts[:n]))
        del parts[:n]
        level.count[b] -= size
        self.held -= 16 * size
        return k, a

    def _open(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Load the next bucket that holds something, or give a piece of it if it has one key."""
        while True:
            self._deal()
            level = self.levels[-1]
            while level.turn < level.fan and not level.count[level.turn]:
                level.turn += 1
            if level.turn == level.fan:
                if len(self.levels) == 1:
                    return None
                self.levels.pop()
                self.levels[-1].turn += 1
                continue
            b, start = level.turn, level.base + level.turn * level.width
            stop = min(start + level.width, level.end)
            if level.width == 1:
                return self._pop(level, b, CHUNK)
            if level.count[b] > LOAD:
                self.levels.append(_Level(start, stop - start, 4 * level.count[b] // LOAD))
                while level.count[b]:
                    self.fresh.append(self._pop(level, b, CHUNK))
                    self.n_fresh += len(self.fresh[-1][0])
                    self._deal()
                continue
            found = []
            while level.count[b]:
                found.append(self._pop(level, b, CHUNK))
            k, a = (np.concatenate(x) for x in zip(*found))
            order = np.argsort((k - start) * len(k) + np.arange(len(k)))  # no two are equal, so that any sort will do
            self.keys, self.at, self.stop, self.fresh_bucket = k[order], a[order], stop, True
            level.turn += 1
            return None if not len(k) else (self.keys[:0], self.at[:0])

    def _whole(self, induced: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
        """The open bucket and all that is induced within it, in order; None if a chain of entries that induce one another is longer than WAVES.

        Of equal keys, what came from outside is first, the rest follows the order of its
        sources, and so of their sources: entries that still tie are told apart by the
        places of sources twice as far back each time.
        """
        outer, first = self.keys, len(self.keys)
        inner, later, front, base, n = [], [], self.at, 0, len(self.keys)
        for _ in range(WAVES):
            k, a, s = induced(front)
            s, inside = s + base, k < self.stop
            later.append((k[~inside], a[~inside], s[~inside]))
            if not inside.any():
                break
            inner.append((k[inside], a[inside], s[inside]))
            front, base = a[inside], n
            n += len(front)
        else:
            return None
        keys, at, sources = (np.concatenate(x) for x in zip(*inner)) if inner else (outer[:0],) * 3
        sorted_keys = np.sort(keys)
        place = np.empty(n, dtype=np.int64)  # in the whole order; the first one's of those that tie
        place[:first] = np.arange(first) + np.searchsorted(sorted_keys, outer)
        place[first:] = np.searchsorted(outer, keys, side="right") + np.searchsorted(sorted_keys, keys)
        back, tied = np.concatenate((np.arange(first), sources)), np.arange(first, n)
        while len(tied):
            by = place[tied] * n + place[back[tied]]
            order = np.argsort(by)
            tied, by = tied[order], by[order]
            old, index = place[tied], np.arange(len(tied))
            group = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), index, 0))
            new = np.concatenate(([True], by[1:] != by[:-1]))
            place[tied] = old + np.maximum.accumulate(np.where(new, index, 0)) - group
            tied = tied[~(new & np.append(new[1:], True))]
            back = back[back]
        got = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for out, x, y in zip(got, (outer, self.at), (keys, at)):
            out[place[:first]], out[place[first:]] = x, y
        self.keys = self.at = outer[:0]
        k, a, s = (np.concatenate(x) for x in zip(*later))
        by = np.argsort(place[s])
        self.push(k[by], a[by])
        return got

    def take(self, induced: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """The next (keys, positions), as many as do not wait for one another; what they induce is pushed. induced(positions): keys, positions, index of the inducing entry."""
        while True:
            if len(self.keys):
                if induced is not None and self.fresh_bucket:
                    self.fresh_bucket = False
                    got = self._whole(induced)
                    if got is not None:
                        return got
                k, a = self.keys[:AHEAD], self.at[:AHEAD]
                n = len(k)
                if induced is not None:
                    keys, at, source = induced(a)
                    least = np.full(n, np.iinfo(np.int64).max)
                    least[source] = keys
                    late = k[1:] > np.minimum.accumulate(least)[:-1]
                    n = int(late.argmax()) + 1 if late.any() else n
                self.keys, self.at = self.keys[n:], self.at[n:]
                if induced is not None:
                    self.push(keys[source < n], at[source < n])
                return k[:n], a[:n]
            got = self._open()
            if got is None:
                return None
            if len(got[0]):
                if induced is not None:
                    keys, at, _ = induced(got[1])
                    self.push(keys, at)
                return got


# ---------------------------------------------------------------- one string


class Text:
    """A string of symbols in a file, with the types of its suffixes and its LMS suffixes in files beside it."""

    def __init__(self, symbols: np.ndarray, count: int, folder: str, memory: int):
        self.symbols, self.count, self.folder, self.memory, self.n = symbols, count, tempfile.mkdtemp(dir=folder), memory, len(symbols)
        self.spills = 0
        self.small = self._types()
        self.lms = self._run("lms")
        for a in range(0, self.n, 4 * CHUNK):
            s = self.small[max(a - 1, 0) : a + 4 * CHUNK]
            self.lms.append(np.flatnonzero(s[1:] & ~s[:-1]) + max(a - 1, 0) + 1)

    def _types(self) -> np.ndarray:
        """True where a suffix is smaller than its follower (S)."""
        if not self.n:
            return np.zeros(0, dtype=bool)
        out = np.memmap(f"{self.folder}/types", dtype=bool, mode="w+", shape=(self.n,))
        later = False
        for b in range(self.n, 0, -4 * CHUNK):
            a = max(0, b - 4 * CHUNK)
            x = self.symbols[a : b + 1].astype(np.int64)
            step = np.sign(x[1:] - x[:-1])
            if b == self.n:
                step = np.append(step, -1)
            decides = np.minimum.accumulate(np.where(step != 0, np.arange(b - a), b - a)[::-1])[::-1]
            own = np.where(decides < b - a, step[np.minimum(decides, b - a - 1)] > 0, later)
            out[a:b], later = own, bool(own[0])
        out.flush()
        return np.asarray(np.memmap(f"{self.folder}/types", dtype=bool, mode="r"))

    def is_lms(self, at: np.ndarray) -> np.ndarray:
        return (at > 0) & self.small[at] & ~self.small[at - 1]

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def _run(self, name: str) -> Run:
        return Run(f"{self.folder}/{name}", whole(self.n))

    def _sweep(self, seeds: Iterable[np.ndarray], up: bool, name: str) -> Run:
        """The L suffixes in order, from LMS seeds (up), or the S suffixes in falling order, from falling L suffixes (down)."""
        queue, out = Queue(self.folder, 2 * self.count, self.n, self.memory), self._run(name)
        symbols, small, top = self.symbols, self.small, self.count - 1

        def key(at: np.ndarray) -> np.ndarray:
            s = symbols[at].astype(np.int64)
            return 2 * s if up else 2 * (top - s)

        def induced(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            source = np.flatnonzero(at > 0)
            to = at[source] - 1
            own = small[to] != up
            to = to[own]
            return key(to), to, source[own]

        if up and self.n:
            last = np.array([self.n - 1])  # induced by the empty suffix
            queue.push(key(last), last)
        for at in seeds:
            queue.push(key(at) + 1, at)
        while (got := queue.take(induced)) is not None:
            keys, at = got
            out.append(at[(keys & 1) == 0])
        self.spills += queue.spills
        queue.close()
        return out.flush()

    def _differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of LMS substrings differ."""
        out, open_, k = np.ones(len(a), dtype=bool), np.arange(len(a)), 0
        while len(open_):
            x, y = a[open_] + k, b[open_] + k
            inside = np.maximum(x, y) < self.n
            open_, x, y = open_[inside], x[inside], y[inside]
            same = (self.symbols[x] == self.symbols[y]) & (self.small[x] == self.small[y])
            open_, x = open_[same], x[same]
            if k:
                ended = self.is_lms(x)
                out[open_[ended]] = False
                open_ = open_[~ended]
            k += 1
        return out

    def sorted_lms(self) -> Run:
        """The LMS suffixes in order."""
        if self.lms.n < 2:
            return self.lms
        large = self._sweep(self.lms.chunks(), True, "name-large")
        less = self._sweep(large.backwards(), False, "name-less")
        large.drop()
        order, names, before, name = self._run("by-substring"), Queue(self.folder, self.n, self.n, self.memory, self.n // LOAD + 1), None, -1
        for part in less.backwards():
            part = part[self.is_lms(part)]
            if not len(part):
                continue
            new = np.ones(len(part), dtype=np.int64)
            new[1:] = self._differ(part[:-1], part[1:])
            if before is not None:
                new[0] = self._differ(before, part[:1])[0]
            own = name + np.cumsum(new)
            before, name = part[-1:], int(own[-1])
            order.append(part)
            names.push(part, own)
        less.drop()
        if name + 1 == self.lms.n:
            names.close()
            return order.flush()
        order.drop()
        string = self._run("names")
        while (got := names.take()) is not None:
            string.append(got[1])
        self.spills += names.spills
        names.close()
        lms, out = self.lms.view(), self._run("sorted-lms")
        inner = Text(string.view(), name + 1, self.folder, self.memory)
        for part in inner.order():
            out.append(lms[part])
        self.spills += inner.spills
        inner.close()
        string.drop()
        return out.flush()

    def order(self) -> Iterator[np.ndarray]:
        """All suffixes in order."""
        if self.n <= BASE:
            rank, step = np.unique(self.symbols, return_inverse=True)[1].astype(np.int64), 1
            while step < self.n and rank.max() + 1 < self.n:
                second = np.zeros(self.n, dtype=np.int64)
                second[:-step] = rank[step:] + 1
                rank = np.unique(rank * (self.n + 1) + second, return_inverse=True)[1].astype(np.int64)
                step *= 2
            yield np.argsort(rank, kind="stable")
            return
        first = self.sorted_lms()
        large = self._sweep(first.chunks(), True, "large")
        first.drop()
        less = self._sweep(large.backwards(), False, "less")
        none = np.zeros(0, dtype=np.int64)
        x, y, xs, ys = none, none, large.chunks(), less.backwards()
        while True:
            if not len(x):
                x = next(xs, none)
            if not len(y):
                y = next(ys, none)
            if not len(x) or not len(y):
                break
            kx, ky = 2 * self.symbols[x].astype(np.int64), 2 * self.symbols[y].astype(np.int64) + 1  # of one symbol, L comes before S
            cut = min(kx[-1], ky[-1])
            i, j = np.searchsorted(kx, cut, side="right"), np.searchsorted(ky, cut, side="right")
            both = np.concatenate((x[:i], y[:j]))
            yield both[np.argsort(np.concatenate((kx[:i], ky[:j])), kind="stable")]
            x, y = x[i:], y[j:]
        yield from (p for p in (x, *xs, y, *ys) if len(p))


# ---------------------------------------------------------------- bytes, with common prefixes


class TupleQueues:
    """A first-in first-out queue of (position, common prefix) for each byte, in memory up to a budget and on disk beyond."""

    def __init__(self, folder: str, dtype: np.dtype, memory: int = MEMORY_BYTES):
        self.folder, self.dtype, self.memory, self.held = tempfile.mkdtemp(dir=folder), dtype, memory, 0
        self.parts: list[list[np.ndarray]] = [[] for _ in range(256)]
        self.written, self.read = [0] * 256, [0] * 256
        self.count = [0] * 256
        self.spills = 0

    def push(self, byte: int, at: np.ndarray, lcp: np.ndarray) -> None:
        part = np.empty(len(at), dtype=self.dtype)
        part["at"], part["lcp"] = at, lcp
        self.parts[byte].append(part)
        self.count[byte] += len(at)
        self.held += part.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        for byte, parts in enumerate(self.parts):
            if parts:
                with open(f"{self.folder}/{byte}", "ab") as f:
                    for p in parts:
                        f.write(p.tobytes())
                        self.written[byte] += len(p)
                self.parts[byte] = []
        self.held = 0
        self.spills += 1

    def pop(self, byte: int) -> np.ndarray | None:
        """The next chunk, or None. What is on disk was pushed before what is in memory."""
        left = self.written[byte] - self.read[byte]
        if left:
            n = min(left, CHUNK)
            out = np.fromfile(f"{self.folder}/{byte}", dtype=self.dtype, count=n, offset=self.read[byte] * self.dtype.itemsize)
            self.read[byte] += n
            if n == left:
                os.remove(f"{self.folder}/{byte}")
                self.written[byte] = self.read[byte] = 0
            return out
        if self.parts[byte]:
            n, size = 0, 0
            while n < len(self.parts[byte]) and (not n or size + len(self.parts[byte][n]) <= CHUNK):
                size += len(self.parts[byte][n])
                n += 1
            out = np.concatenate(self.parts[byte][:n])
            del self.parts[byte][:n]
            self.held -= out.nbytes
            return out
        return None

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class InducedSorter:
    """Sorts the suffixes of a file of bytes; suffixes() then gives them in order with their common prefixes."""

    def __init__(self, path: str, limit: int, folder: str | None = None, memory: int = MEMORY_BYTES):
        self.folder = tempfile.mkdtemp(dir=folder, prefix="suffixes-")
        self.limit, self.memory, self.n, self.spills = limit, memory, os.path.getsize(path), 0
        self.dtype = tuples(self.n, limit)
        self.text = np.asarray(np.memmap(path, dtype=np.uint8, mode="r")) if self.n else np.zeros(0, dtype=np.uint8)
        data = self.text if self.n >= 8 else np.append(self.text, np.zeros(8 - self.n, dtype=np.uint8))
        self.words = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
        self.string = Text(self.text, 256, self.folder, memory)
        self.small = self.string.small

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def _words(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each position as a number, the first byte lowest; zeros stand behind the last byte."""
        over = at - (len(self.words) - 1)
        if over.max() <= 0:
            return self.words[at]
        over = np.maximum(over, 0)
        return self.words[at - over] >> (8 * over).astype(np.uint64)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes up to the limit, eight bytes at a time."""
        out = np.minimum(self.limit, self.n - np.maximum(a, b))
        open_, done = np.flatnonzero(out > 0), 0
        while len(open_):
            differ = self._words(a[open_] + done) ^ self._words(b[open_] + done)
            ended = differ != 0
            low = differ[ended]
            own = open_[ended]
            out[own] = np.minimum(out[own], done + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3))
            done += 8
            open_ = open_[~ended]
            open_ = open_[out[open_] > done]
        return out

    def _one_common(self, a: int, b: int) -> int:
        return int(self._common(np.array([a]), np.array([b]))[0])

    def _sweep(self, seeds: dict[int, Run], up: bool, runs: dict[int, Run] | None, name: str) -> dict[int, Run]:
        """Induce L suffixes from ordered LMS seeds (up), or S suffixes from the runs of L suffixes (down)."""
        text, queues, out = self.text, TupleQueues(self.folder, self.dtype, self.memory), {}
        passed = np.full(256, self.limit, dtype=np.int64)
        before, n = -1, 0

        def emit(part: np.ndarray) -> None:
            at, lcp = part["at"].astype(np.int64), part["lcp"].astype(np.int64)
            source = np.flatnonzero(at > 0)
            to = at[source] - 1
            own = self.small[to] != up
            source, to = source[own], to[own]
            first = text[to]
            order = np.argsort(first, kind="stable")
            source, to, first = source[order], to[order], first[order]
            edges = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))).tolist() if len(first) else []
            least = int(lcp.min())
            until = passed.copy()
            np.minimum(passed, least, out=passed)
            padded = np.append(lcp, self.limit)
            for i, j in zip(edges, [*edges[1:], len(first)]):
                byte, where = int(first[i]), source[i:j]
                low = np.empty(j - i, dtype=np.int64)
                low[1:] = np.minimum.reduceat(padded, where + 1)[:-1] if j - i > 1 else 0
                low[0] = min(int(until[byte]), int(lcp[: where[0] + 1].min()))
                value = np.minimum(low + 1, self.limit)
                if not queues.count[byte]:
                    value[0] = 0
                queues.push(byte, to[i:j], value)
                passed[byte] = int(padded[where[-1] + 1 :].min())

        if up and self.n:
            queues.push(int(text[self.n - 1]), np.array([self.n - 1]), np.array([0]))  # induced by the empty suffix
            passed[:] = 0
        for byte in range(256) if up else range(255, -1, -1):
            run = out[byte] = Run(f"{self.folder}/{name}", self.dtype, n)
            new = True
            while (part := queues.pop(byte)) is not None:
                if new:
                    part["lcp"][0], new = 0, False
                run.append(part)
                before = int(part["at"][-1])
                emit(part)
            rest = seeds[byte].chunks() if byte in seeds else self._backwards(runs[byte]) if runs else ()
            for part in rest:
                if not new and part["lcp"][0] < 0:
                    part["lcp"][0] = self._one_common(before, int(part["at"][0]))
                part["lcp"][0] = max(int(part["lcp"][0]), 0)
                new = False
                before = int(part["at"][-1])
                emit(part)
            n += run.flush().n
        queues.close()
        self.spills += queues.spills
        return out

    @staticmethod
    def _backwards(run: Run) -> Iterator[np.ndarray]:
        """Chunks of a run from its end, each value being the common prefix with the suffix that comes before it in this order; -1 for the first."""
        after = -1
        for part in run.backwards():
            part = part.copy()
            lcp = part["lcp"].copy()
            part["lcp"][0] = after
            part["lcp"][1:] = lcp[:-1]
            after = int(lcp[-1])
            yield part

    def _seeds(self, order: Run) -> dict[int, Run]:
        """The LMS suffixes by first byte, with the common prefix with the one before; -1 for the first of a byte, which is told apart from the last L suffix later."""
        out: dict[int, Run] = {}
        before, last, n = None, None, 0
        for at in order.chunks():
            a = np.concatenate((at[:1] if before is None else before, at[:-1]))
            part = np.empty(len(at), dtype=self.dtype)
            part["at"], part["lcp"] = at, self._common(a, at)
            first = self.text[at]
            edges = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))).tolist()
            for i, j in zip(edges, [*edges[1:], len(first)]):
                byte = int(first[i])
                if byte not in out:
                    n += last.flush().n if last else 0
                    last = out[byte] = Run(f"{self.folder}/seeds", self.dtype, n)
                    part["lcp"][i] = -1
                out[byte].append(part[i:j])
            before = at[-1:]
        return out

    def sort(self) -> None:
        """Sort all suffixes; the runs are then on disk."""
        order = self.string.sorted_lms()
        self.spills += self.string.spills
        seeds = self._seeds(order)
        order.drop()
        self.large = self._sweep(seeds, True, None, "L")
        for run in seeds.values():
            run.drop()
        self.less = self._sweep({}, False, self.large, "S")

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, common prefix with the suffix before) in order, a piece at a time; the first of a byte has 0."""
        for byte in range(256):
            last = None
            for part in self.large[byte].chunks():
                yield part["at"].astype(np.int64), part["lcp"].astype(np.int64)
                last = int(part["at"][-1])
            for part in self._backwards(self.less[byte]):
                lcp = part["lcp"].astype(np.int64)
                if lcp[0] < 0:
                    lcp[0] = self._one_common(last, int(part["at"][0])) if last is not None else 0
                yield part["at"].astype(np.int64), lcp
