"""External induced sorting of suffixes, with common prefixes up to a cap.

Suffixes are of type S (smaller than their successor) or L. The S suffixes that
follow an L suffix are the seeds. Two sweeps induce all others: in ascending
order every suffix sends the tuple of its predecessor, if that is of type L, to
a priority queue ordered by first symbol and order of arrival; in descending
order the same for type S. A tuple carries the suffix and its common prefix with
the tuple that went before it to the same symbol: one more than the minimum of
the prefixes swept since then, found in a sparse table.

The seeds' own order: the pieces between seeds are sorted (by runs on disk, if
they are many) and named, and where pieces are equal the sorted suffixes of the
string of names decide, by recursion. A name at depth k spans at least 2^k
symbols, so no more levels are needed than the cap asks for.

Queues work in bulk. Of a small alphabet a sweep takes the tuples of one symbol,
again and again until none is left; of a large one those of a range of symbols,
with all that they send into the range in a few rounds, and ranks them together.
Runs that outgrow a limit, and all long
arrays, lie in unnamed temporary files on the task's own disk, which vanish with
the task; memory is bounded by that limit, not by the text's length.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples a queue holds in memory, bytes of an array in memory, items handled at once.
QUEUE, HELD, BULK = 1 << 20, 96 << 20, 1 << 17


def alloc(n: int, dtype, held: int = HELD) -> np.ndarray:
    """Zeros; in a temporary file if they take more than ``held`` bytes."""
    dtype = np.dtype(dtype)
    if n * dtype.itemsize <= held:
        return np.zeros(n, dtype)
    file = tempfile.TemporaryFile()
    file.truncate(n * dtype.itemsize)
    return np.memmap(file, dtype, "r+", shape=(n,))


def order_of(keys: np.ndarray) -> np.ndarray:
    """The stable order by integer keys: by radix if they are short, else by sorting keys and places as one number where that fits."""
    if keys.dtype.itemsize <= 2 or len(keys) < 2:
        return np.argsort(keys, kind="stable")
    low, places = int(keys.min()), len(keys).bit_length()
    if (int(keys.max()) - low).bit_length() + places > 63:
        return np.argsort(keys, kind="stable")
    both = ((keys.astype(np.int64) - low) << places) | np.arange(len(keys))
    both.sort()
    return both & ((1 << places) - 1)


class Spool:
    """An array that grows at its end, on disk once it is long."""

    def __init__(self, dtype, held: int = HELD):
        self.dtype, self.held, self.n, self.parts, self.file = np.dtype(dtype), held, 0, [], None

    def append(self, values: np.ndarray) -> None:
        values = np.ascontiguousarray(values, self.dtype)
        self.n += len(values)
        if self.file is None:
            self.parts.append(values)
            if self.n * self.dtype.itemsize > self.held:
                self.file = tempfile.TemporaryFile()
                for part in self.parts:
                    part.tofile(self.file)
                self.parts = []
        else:
            values.tofile(self.file)

    def array(self) -> np.ndarray:
        if self.file is None:
            whole = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
            self.parts = [whole]
            return whole
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r", shape=(self.n,))


class Run:
    """Tuples sorted by key, from ``at`` on."""

    def __init__(self, columns: tuple, at: int = 0):
        self.columns, self.at = columns, at
        self.size, self.on_disk = len(columns[0]), False

    def left(self) -> int:
        return self.size - self.at

    def rest(self) -> tuple:
        return tuple(c[self.at :] for c in self.columns)

    def to_disk(self) -> None:
        out = []
        for c in self.columns:
            file = tempfile.TemporaryFile()
            c[self.at :].tofile(file)
            file.flush()
            out.append(np.memmap(file, c.dtype, "r", shape=(self.size - self.at,)))
        self.columns, self.at, self.size, self.on_disk = tuple(out), 0, self.size - self.at, True

    def end(self, bound: int) -> int:
        keys = self.columns[0]
        if self.at == self.size or int(keys[self.at]) >= bound:
            return self.at
        if int(keys[-1]) < bound:
            return self.size
        return self.at + int(keys[self.at :].searchsorted(keys.dtype.type(bound)))


class BulkQueue:
    """Disk-backed priority queue of (key, suffix, prefix): least key first, equal keys as they came."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.runs, self.spilled = limit, [], 0

    def push(self, columns: tuple, front: bool = False) -> None:
        """Tuples in the order of their arrival; ``front``: taken before, and put back."""
        if not len(columns[0]):
            return
        if front:
            self.runs.insert(0, Run(columns))
            return
        order = order_of(columns[0])
        self.runs = [r for r in self.runs if r.left()]
        self.runs.append(Run(tuple(c[order] for c in columns)))
        while len(self.runs) > 1 and not self.runs[-2].on_disk and self.runs[-2].left() <= 2 * self.runs[-1].left():
            self._merge_last()
        if sum(r.left() for r in self.runs if not r.on_disk) > self.limit:
            self.spilled += 1
            while len(self.runs) > 1 and not self.runs[-2].on_disk:
                self._merge_last()
            self.runs[-1].to_disk()

    def _merge_last(self) -> None:
        b, a = self.runs.pop(), self.runs.pop()
        self.runs.append(Run(self._merged([a.rest(), b.rest()])))

    @staticmethod
    def _merged(parts: list[tuple]) -> tuple:
        if len(parts) == 1:
            return parts[0]
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = order_of(columns[0])
        return tuple(c[order] for c in columns)

    def least(self) -> int | None:
        self.runs = [r for r in self.runs if r.left()]
        return min((int(r.columns[0][r.at]) for r in self.runs), default=None)

    def count(self, bound: int) -> int:
        """Tuples with keys below ``bound``."""
        return sum(r.end(bound) - r.at for r in self.runs)

    def take(self, bound: int) -> tuple | None:
        """All tuples with keys below ``bound``."""
        parts = []
        for r in self.runs:
            end = r.end(bound)
            if end > r.at:
                parts.append(tuple(np.asarray(c[r.at : end]) for c in r.columns))
                r.at = end
        return self._merged(parts) if parts else None

    def drain(self, bulk: int):
        """All tuples in order, some ``bulk`` from each run at a time."""
        while self.least() is not None:
            bound = min(int(r.columns[0][min(r.at + bulk, r.size - 1)]) for r in self.runs)
            yield self.take(bound + 1)

    def take_some(self, key: int, most: int) -> tuple:
        """Up to ``most`` tuples of the least key, as they came."""
        parts = []
        for r in self.runs:
            end = min(r.end(key + 1), r.at + most)
            if end > r.at:
                parts.append(tuple(np.asarray(c[r.at : end]) for c in r.columns))
                most -= end - r.at
                r.at = end
            if not most:
                break
        return tuple(np.concatenate(c) for c in zip(*parts))


class Minima:
    """For each key, the least of the values swept since a tuple was last sent to it."""

    def __init__(self, low: int, high: int, cap: int):
        self.low, self.cap = low, cap
        self.now = np.zeros(high - low + 1, np.uint8)

    def clear(self) -> None:
        self.now[:] = 0

    def send(self, values: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Prefixes of the tuples that items ``at`` of the swept ``values`` send to ``keys``."""
        if not len(at):
            if len(values):
                np.minimum(self.now, values.min(), out=self.now)
            return np.zeros(0, np.uint8)
        order = order_of(keys)
        k, place = keys[order].astype(np.int64) - self.low, at[order]
        first = np.concatenate(([True], k[1:] != k[:-1]))
        last = np.concatenate((first[1:], [True]))
        out = np.empty(len(at), np.uint8)
        heads = np.minimum.accumulate(values)
        tails = np.concatenate((np.minimum.accumulate(values[::-1])[::-1][1:], [self.cap])).astype(np.uint8)
        out[order[first]] = np.minimum(self.now[k[first]], heads[place[first]])
        later = np.flatnonzero(~first)
        if len(later):
            out[order[later]] = self._least(values, place[later - 1] + 1, place[later])
        sent = np.zeros(len(self.now), bool)
        sent[k[last]] = True
        np.minimum(self.now, heads[-1], out=self.now, where=~sent)
        self.now[k[last]] = tails[place[last]]
        return np.minimum(out + np.uint8(1), np.uint8(self.cap))

    @staticmethod
    def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima over a..b, by a sparse table made level by level."""
        level = np.frexp(b - a + 1)[1] - 1
        out, table = np.empty(len(a), np.uint8), values
        for k in range(int(level.max()) + 1):
            if k:
                half = 1 << (k - 1)
                table = np.minimum(table[:-half], table[half:])
            x = np.flatnonzero(level == k)
            if len(x):
                out[x] = np.minimum(table[a[x]], table[b[x] - (1 << k) + 1])
        return out


class Text:
    """Symbols with the unique least one at the end (0), padded for wide reads."""

    def __init__(self, symbols: np.ndarray, n: int):
        self.t, self.n = symbols, n

    @staticmethod
    def of(symbols: np.ndarray) -> "Text":
        """From symbols of 1 and more; adds the end and the padding."""
        out = alloc(len(symbols) + 1 + 8, symbols.dtype)
        out[: len(symbols)] = symbols
        return Text(out, len(symbols) + 1)

    def seeds(self, bulk: int) -> np.ndarray:
        """Positions of S suffixes that follow L suffixes, the end's included."""
        is_s = alloc(self.n, bool)
        is_s[self.n - 1] = after = True
        for b in range(self.n - 1, 0, -bulk):
            a = max(0, b - bulk)
            here, there = self.t[a:b], self.t[a + 1 : b + 1]
            step = np.sign(there.astype(np.int64) - here)
            # Equal neighbours take the type of the next unequal pair.
            at = np.where(step != 0, np.arange(b - a), b - a)
            at = np.minimum.accumulate(at[::-1])[::-1]
            is_s[a:b] = np.concatenate((step > 0, [after]))[at]
            after = bool(is_s[a])
        out = Spool(np.int32 if self.n < 1 << 31 else np.int64)
        for a in range(1, self.n, bulk):
            b = min(self.n, a + bulk)
            out.append(np.flatnonzero(is_s[a:b] & ~is_s[a - 1 : b - 1]) + a)
        return out.array()

    def run(self, at: int, cap: int) -> int:
        """How often the symbol at ``at`` stands there in a row, up to ``cap``."""
        window = self.t[at : at + cap]
        other = np.flatnonzero(window != window[0])
        return int(other[0]) if len(other) else len(window)

    def common(self, p: np.ndarray, q: np.ndarray, cap: int) -> np.ndarray:
        """Common prefixes of pairs of suffixes, up to ``cap`` symbols, by direct comparison of 8 bytes at a time."""
        each, bits = 8 // self.t.itemsize, 8 * self.t.itemsize
        wide = np.ndarray((len(self.t) - each + 1,), np.uint64, self.t, strides=(self.t.itemsize,))
        out = np.full(len(p), cap, np.uint8)
        live = np.arange(len(p))
        for k in range(0, cap, each):
            a, b = p[live] + k, q[live] + k
            fits = (a < len(wide)) & (b < len(wide))
            out[live[~fits]] = np.minimum(out[live[~fits]], k)  # cannot be: the end differs before
            live, a, b = live[fits], a[fits], b[fits]
            x = wide[a] ^ wide[b]
            differ = x != 0
            y = x[differ]
            zeros = np.frexp((y & (~y + np.uint64(1))).astype(np.float64))[1] - 1
            out[live[differ]] = np.minimum(k + zeros // bits, cap)
            live = live[~differ]
            if not len(live):
                break
        return out


class Seeds:
    """Seeds in order, read by key."""

    def __init__(self, text: Text, pos: np.ndarray, sign: int):
        self.t, self.pos, self.sign, self.at = text.t, pos, sign, 0

    def key(self, k: int) -> int:
        return self.sign * int(self.t[self.pos[k]])

    def least(self) -> int | None:
        return self.key(self.at) if self.at < len(self.pos) else None

    def end(self, bound: int) -> int:
        """First seed left whose key is ``bound`` or more; steps grow, then halve."""
        step, lo, n = 1, self.at, len(self.pos)
        while lo + step < n and self.key(lo + step) < bound:
            lo, step = lo + step, step * 2
        hi = min(n, lo + step)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.key(mid) < bound:
                lo = mid + 1
            else:
                hi = mid
        return lo


def _before(text: Text, sign: int, pos: np.ndarray, keys, own) -> tuple[np.ndarray, np.ndarray]:
    """Items whose predecessors are induced, and the predecessors' keys."""
    up = sign * text.t[np.maximum(pos - 1, 0)].astype(np.int64)
    valid = np.flatnonzero((pos > 0) & ((up > keys) | (own & (up == keys))))
    return valid, up[valid]


#: Steps of a chain of tuples inside one range.
ROUNDS = 1 << 10


def _range(text: Text, sign: int, bound: int, keys: np.ndarray, pos: np.ndarray, phase: np.ndarray, most: int) -> tuple | None:
    """Ranks the tuples of a range (in order) and those they send into it; None if these are too many.

    Of one symbol the queue's tuples (phase 0) come first, then what the range
    itself sends (phase 1) by the rank of the sender, then the seeds (phase 2).
    Returns suffixes and whether they are induced, in order, and what is sent on.
    """
    n, c = len(pos), int(keys[0])
    all_pos, all_keys, all_phase, sender = [pos], [keys], [phase], [np.arange(n)]
    sent_from, sent_keys, start, total = [], [], 0, n
    while True:
        valid, up = _before(text, sign, all_pos[-1], all_keys[-1], all_phase[-1] < 2)
        inside = up < bound
        sent_from.append(valid[~inside] + start)
        sent_keys.append(up[~inside])
        valid, up = valid[inside], up[inside]
        if not len(valid):
            break
        if len(all_pos) > ROUNDS or total + len(valid) > 2 * most:
            return None
        sender.append(valid + start)
        all_pos.append(all_pos[-1][valid] - 1)
        all_keys.append(up)
        all_phase.append(np.ones(len(up), np.int64))
        start, total = total, total + len(valid)
    pos, keys, phase, sender = (np.concatenate(x) for x in (all_pos, all_keys, all_phase, sender))
    value = ((keys - c) * 3 + phase) * (n + 1)
    value[:n] += np.arange(n)
    # A chain of senders ends in a tuple taken: ranks by 1, 2, 4, ... of its steps.
    seen = 1
    while True:
        order = order_of(value)
        rank = np.empty(total, np.int64)
        ordered = value[order]
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if seen >= len(all_pos):
            break
        value = rank * (total + 1) + rank[sender]
        sender, seen = sender[sender], 2 * seen
    origin, sent = np.concatenate(sent_from), np.concatenate(sent_keys)
    by_sender = order_of(rank[origin])
    return pos[order], phase[order] < 2, pos[origin[by_sender]] - 1, sent[by_sender]


def sweep(
    text: Text, seeds: np.ndarray, prefixes: np.ndarray | None, sign: int, cap: int, queue: BulkQueue, bulk: int = BULK, wide: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """Induces one type from seeds in order (``sign`` 1: type L, ascending; -1: type S, descending).

    Returns the induced suffixes in order and, if ``prefixes`` (each seed's
    common prefix with the seed before) are given, their common prefixes with
    the suffix before, up to ``cap``. ``wide``: ranges of symbols at once.
    """
    carry, left = prefixes is not None, Seeds(text, seeds, sign)
    out, out_lcp = Spool(seeds.dtype), Spool(np.uint8) if carry else None
    key_type = np.int32 if wide else np.int16
    top = 0 if wide else int(text.t[: text.n].max())
    minima = Minima(min(0, sign * top), max(0, sign * top), cap) if carry else None
    width, now, last = 1 << 10, None, None
    while True:
        both = [x for x in (queue.least(), left.least()) if x is not None]
        if not both:
            break
        c = min(both)
        if wide and c != now:
            while width > 1 and queue.count(c + width) + left.end(c + width) - left.at > bulk:
                width //= 2
            if width > 1:
                end = left.end(c + width)
                took = queue.take(c + width)
                pos_s = np.asarray(seeds[left.at : end])
                pos_q = took[1] if took is not None else pos_s[:0]
                keys = np.concatenate((took[0].astype(np.int64) if took is not None else pos_s[:0].astype(np.int64), sign * text.t[pos_s].astype(np.int64)))
                pos, phase = np.concatenate((pos_q, pos_s)), np.repeat([0, 2], [len(pos_q), len(pos_s)])
                order = order_of(keys)
                made = _range(text, sign, c + width, keys[order], pos[order], phase[order], bulk)
                if made is not None:
                    pos, own, on, on_keys = made
                    out.append(pos[own])
                    queue.push((on_keys.astype(key_type), on))
                    left.at = end
                    width = min(2 * width, 1 << 30)
                    continue
                if took is not None:
                    queue.push(took, front=True)
                width //= 2
                if width > 1:
                    continue
            width = 2
        # One symbol: first what the queue has of it, then the seeds.
        if c != now:
            now, last = c, None
            if carry:
                minima.clear()
        own = queue.least() == c
        if own:
            took = queue.take_some(c, bulk)
            pos, lcp = took[1], took[2].copy() if carry else None
        else:
            end = min(left.end(c + 1), left.at + bulk)
            pos, lcp = np.asarray(seeds[left.at : end]), np.array(prefixes[left.at : end]) if carry else None
            left.at = end
        if carry:
            if last is None:
                lcp[0] = 0
            elif last[0] and not own:
                lcp[0] = min(text.run(last[1], cap), text.run(int(pos[0]), cap))
        last = own, int(pos[-1])
        if own:
            out.append(pos)
            if carry:
                out_lcp.append(lcp)
        valid, up = _before(text, sign, pos, c, own)
        up = up.astype(key_type)
        columns = (up, pos[valid] - 1)
        queue.push((*columns, minima.send(lcp, valid, up)) if carry else columns)
    return out.array(), out_lcp.array() if carry else None


def in_order(keys: list[np.ndarray], held: int = HELD) -> np.ndarray:
    """The order by several keys, the first one most important; by runs on disk if they are long."""
    n = len(keys[0])
    if 16 * n <= held:
        return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    order = None
    for key in keys[::-1]:
        queue, out = BulkQueue(max(1, held // 64)), Spool(np.int64)
        for a in range(0, n, BULK):
            some = np.arange(a, min(n, a + BULK)) if order is None else np.asarray(order[a : a + BULK])
            queue.push((np.asarray(key[some], np.int64), some))
        for _, some in queue.drain(BULK):
            out.append(some)
        order = out.array()
    return order


def name_pieces(text: Text, seeds: np.ndarray, bulk: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds' numbers sorted by the pieces from each to the next, and each seed's name: the rank of its piece.

    A piece that goes on where another one ends has a symbol of type L there, and
    comes before: ended pieces go on with the greatest symbol. Symbols are packed
    into wide keys; pieces that are equal so far and longer are sorted again by
    what follows.
    """
    m = len(seeds)
    highest = max(int(text.t[a : a + bulk].max()) for a in range(0, text.n, bulk)) + 1
    bits = highest.bit_length()
    each, pad = 63 // bits, (1 << bits) - 1

    def key(index: np.ndarray, skip: int) -> np.ndarray:
        start = seeds[index].astype(np.int64) + skip
        last = seeds[np.minimum(index + 1, m - 1)]
        out = np.zeros(len(index), np.int64)
        for k in range(each):
            at = start + k
            out = (out << bits) | np.where(at <= last, text.t[np.minimum(at, last)], pad)
        return out

    first = alloc(m, np.int64)
    for a in range(0, m, bulk):
        first[a : a + bulk] = key(np.arange(a, min(m, a + bulk)), 0)
    order = in_order([first])
    names, slots, skip = alloc(m, np.int64), alloc(m, np.int64), 0  # a name so far: the first slot of the equal ones
    held = -1
    for a in range(0, m, bulk):
        some = np.asarray(order[a : a + bulk])
        k = first[some]
        new = np.concatenate(([a == 0 or k[0] != held], k[1:] != k[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(a, a + len(some)), -1))
        slots[a : a + bulk] = np.where(at < 0, slots[a - 1] if a else 0, at)
        held = k[-1]
    names[order] = slots
    del first
    # A key without padding may go on.
    live = np.arange(m)
    while True:
        skip += each
        lengths = seeds[np.minimum(live + 1, m - 1)].astype(np.int64) - seeds[live] + 1
        live = live[lengths >= skip]
        name = names[live]
        several = np.sort(name)
        several = np.unique(several[1:][several[1:] == several[:-1]])
        live = live[np.isin(name, several)]
        if not len(live):
            break
        name, k = names[live], key(live, skip)
        by = in_order([name, k])
        name, k, live = name[by], k[by], live[by]
        new = np.concatenate(([True], (name[1:] != name[:-1]) | (k[1:] != k[:-1])))
        # The equal ones stand in neighbouring slots from their name on.
        head = np.concatenate(([True], name[1:] != name[:-1]))
        run = np.arange(len(live))
        place = name + run - np.maximum.accumulate(np.where(head, run, 0))
        order[place] = live
        names[live] = place[np.maximum.accumulate(np.where(new, run, 0))]
    return order, names


def seeds_in_order(text: Text, depth: int, cap: int, limit: int, bulk: int) -> np.ndarray:
    """All seeds, sorted by their suffixes (by ``cap`` symbols at least)."""
    seeds = text.seeds(bulk)
    m = len(seeds)
    if m < 2:
        return seeds
    order, slots = name_pieces(text, seeds, bulk)
    out = alloc(m, seeds.dtype)
    # Names are dense, in the order of slots, so that the end's is 0.
    names, last, total = alloc(m, np.int32), -1, 0
    for a in range(0, m, bulk):
        some = np.asarray(order[a : a + bulk])
        slot = slots[some]
        new = np.concatenate(([slot[0] != last], slot[1:] != slot[:-1]))
        names[some] = total + np.cumsum(new) - 1
        total, last = total + int(new.sum()), slot[-1]
        out[a : a + bulk] = seeds[some]
    if total == m or 1 << (depth + 1) >= cap:
        return out
    del order, slots
    sorted_names = sort_suffixes(Text(names, m), depth + 1, cap, limit, bulk)
    for a in range(0, m, bulk):
        out[a : a + bulk] = seeds[sorted_names[a : a + bulk]]
    return out


def sort_suffixes(text: Text, depth: int, cap: int, limit: int, bulk: int) -> np.ndarray:
    """All suffixes in order."""
    seeds = seeds_in_order(text, depth, cap, limit, bulk)
    larger, _ = sweep(text, seeds, None, 1, cap, BulkQueue(limit), bulk, True)
    smaller, _ = sweep(text, larger[::-1], None, -1, cap, BulkQueue(limit), bulk, True)
    smaller = smaller[::-1]
    out = alloc(text.n, larger.dtype)
    out[0] = text.n - 1
    # Of equal first symbols, type L comes first.
    l_keys, s_keys = alloc(len(larger), np.int32), alloc(len(smaller), np.int32)
    for keys, pos in ((l_keys, larger), (s_keys, smaller)):
        for a in range(0, len(pos), bulk):
            keys[a : a + bulk] = text.t[pos[a : a + bulk]]
    for a in range(0, len(larger), bulk):
        some = l_keys[a : a + bulk]
        out[1 + a + np.arange(len(some)) + np.searchsorted(s_keys, some, "left")] = larger[a : a + bulk]
    for a in range(0, len(smaller), bulk):
        some = s_keys[a : a + bulk]
        out[1 + a + np.arange(len(some)) + np.searchsorted(l_keys, some, "right")] = smaller[a : a + bulk]
    return out


def sorted_with_prefixes(text: Text, cap: int, limit: int = QUEUE, bulk: int = BULK) -> list[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of type L ascending and of type S descending, each with the common prefix with the one before.

    Together they are all suffixes but the end. Of 8-bit or 16-bit symbols; ``cap`` at most 254.
    """
    seeds = seeds_in_order(text, 0, cap, limit, bulk)
    prefixes = alloc(len(seeds), np.uint8)
    for a in range(0, len(seeds) - 1, bulk):
        some = np.asarray(seeds[a : a + bulk + 1])
        prefixes[a + 1 : a + len(some)] = text.common(some[:-1], some[1:], cap)
    larger, l_lcp = sweep(text, seeds, prefixes, 1, cap, BulkQueue(limit), bulk)
    # Descending, a suffix' common prefix is that with its successor.
    back = larger[::-1]
    back_lcp = alloc(len(back), np.uint8)
    if len(back):
        back_lcp[1:] = l_lcp[1:][::-1]
    smaller, s_lcp = sweep(text, back, back_lcp, -1, cap, BulkQueue(limit), bulk)
    return [(larger, l_lcp), (smaller, s_lcp)]
