"""External induced sorting of a text's suffixes, with common-prefix values.

A suffix is of type S if it is smaller than the next one, else L; an S suffix after an L suffix is S*.  The substrings
between S* places are named in order (in parts of ``memory`` places, dealt by their first symbols); the names form a text
of at most half the length whose suffixes are sorted by recursion, until all names differ or ``internal`` places are left.
From the sorted S* suffixes one pass in ascending order induces all L suffixes and one in descending order all S
suffixes: every suffix read puts its predecessor in a priority queue of (symbol, rank) tuples.

Ranks are given in the order in which tuples come, so a queue is first-in-first-out for each symbol: tuples lie in
memory up to ``memory`` rows, then on disk.  Where values are asked for, a tuple carries its place and the length of the
prefix it shares with the tuple before it under the same symbol: one more than the least such value among the suffixes
read between the two.  Values stop at ``depth``, so those of neighbouring S* suffixes are read off the text; suffixes
equal so far come in any order.

The names' alphabet is as large as their text.  There the recursion takes runs of symbols at once: as long as no suffix of a
run is preceded by another of the same run, all its tuples are in the queue when it begins.  Its queue (``RangeQueue``)
deals tuples over ranges of symbols and reads a range back when the first of its symbols is due.

Text, types, names, orders and queue rows lie in files that are unlinked at once (``tempfile`` of the task) where they
exceed ``memory``: nothing is left behind, and a task that is run again starts anew.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

ROW = np.dtype([("place", "<i8"), ("shared", "u1")])
PAIR = np.dtype([("symbol", "<i8"), ("place", "<i8")])
MEMORY, INTERNAL, BLOCK = 1 << 20, 1 << 12, 1 << 16


class DiskQueue:
    """Tuples by symbol and, within it, in the order they were put; beyond ``memory`` rows they go to disk."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.rows, self.file = memory, 0, None
        self.held: dict[int, list[np.ndarray]] = {}
        self.stored: dict[int, list[tuple[int, int]]] = {}

    def put(self, symbols: np.ndarray, rows: np.ndarray) -> None:
        """Rows already grouped by ascending symbol."""
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])) if len(symbols) else []
        for a, b in zip(first, [*first[1:], len(symbols)], strict=True):
            self.held.setdefault(int(symbols[a]), []).append(rows[a:b])
        self.rows += len(rows)
        if self.rows > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            for s, blocks in self.held.items():
                for block in blocks:
                    self.file.write(block.tobytes())
                    self.stored.setdefault(s, []).append((at, len(block)))
                    at += block.nbytes
            self.held, self.rows = {}, 0

    def _stored(self, symbol: int, at: int, n: int, back: bool = False) -> Iterator[np.ndarray]:
        cuts = range(0, n, BLOCK)
        for k in reversed(cuts) if back else cuts:
            self.file.seek(at + k * ROW.itemsize)
            yield np.frombuffer(self.file.read(min(BLOCK, n - k) * ROW.itemsize), ROW)

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks of the symbol in order, with those put meanwhile; they are gone then."""
        while symbol in self.stored or symbol in self.held:
            if symbol in self.stored:  # older than what is held
                for at, n in self.stored.pop(symbol):
                    yield from self._stored(symbol, at, n)
                continue
            rows = np.concatenate(self.held.pop(symbol))
            self.rows -= len(rows)
            for k in range(0, len(rows), BLOCK):
                yield rows[k : k + BLOCK]

    def blocks(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks of the symbol in order; they stay."""
        for at, n in self.stored.get(symbol, ()):
            yield from self._stored(symbol, at, n)
        yield from self.held.get(symbol, ())

    def backwards(self, symbol: int) -> Iterator[np.ndarray]:
        """The same from the last block on, each in its own order."""
        yield from reversed(self.held.get(symbol, ()))
        for at, n in reversed(self.stored.get(symbol, ())):
            yield from self._stored(symbol, at, n, back=True)


class RangeQueue:
    """(symbol, place) pairs, first-in-first-out by symbol, for large alphabets: dealt over ranges of symbols."""

    def __init__(self, edges: np.ndarray, memory: int):
        self.edges, self.memory, self.rows, self.file = edges, memory, 0, None
        self.held: dict[int, list[np.ndarray]] = {}
        self.stored: dict[int, list[tuple[int, int]]] = {}
        self.current, self.open = -1, np.empty(0, PAIR)

    def put(self, pairs: np.ndarray) -> None:
        if not len(pairs):
            return
        where = np.searchsorted(self.edges, pairs["symbol"], "right")
        order = np.argsort(where, kind="stable")
        where, pairs = where[order], pairs[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        for a, b in zip(first, [*first[1:], len(where)], strict=True):
            if where[a] == self.current:
                self.open = np.concatenate([self.open, pairs[a:b]])
            else:
                self.held.setdefault(int(where[a]), []).append(pairs[a:b])
                self.rows += int(b - a)
        if self.rows > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            for r, blocks in self.held.items():
                rows = np.concatenate(blocks)
                self.file.write(rows.tobytes())
                self.stored.setdefault(r, []).append((at, len(rows)))
                at += rows.nbytes
            self.held, self.rows = {}, 0

    def take(self, low: int, high: int) -> np.ndarray:
        """The pairs of the symbols from low to high (of one range), by symbol and then as they were put; they are gone then."""
        where = int(np.searchsorted(self.edges, low, "right"))
        if where != self.current:
            blocks = []
            for at, n in self.stored.pop(where, ()):
                self.file.seek(at)
                blocks.append(np.frombuffer(self.file.read(n * PAIR.itemsize), PAIR))
            held = self.held.pop(where, [])
            self.rows -= sum(map(len, held))
            self.current, self.open = where, np.concatenate([*blocks, *held, np.empty(0, PAIR)])
        own = (self.open["symbol"] >= low) & (self.open["symbol"] <= high)
        out, self.open = self.open[own], self.open[~own]
        return out[np.argsort(out["symbol"], kind="stable")]


def array(kind, n: int, memory: int) -> np.ndarray:
    """An array of n values, in an unlinked file that is mapped into memory if it is long."""
    if n * 4 <= memory or not n:
        return np.empty(n, kind)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, kind, "w+", shape=n)


def placed(values: np.ndarray, memory: int) -> np.ndarray:
    out = array(values.dtype, len(values), memory)
    out[:] = values
    return out


def rising(text: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """True for suffixes of type S; the last one (a lone least symbol) is S."""
    n = len(text)
    up = array(bool, n, memory)
    up[n - 1] = later = True
    for b in range(n - 1, 0, -BLOCK):
        a = max(0, b - BLOCK)
        part = np.asarray(text[a : b + 1])
        turn = np.flatnonzero(part[1:] != part[:-1])
        k = np.searchsorted(turn, np.arange(b - a))  # the next change; a run that reaches the end has the next part's type
        at = np.append(turn, 0)[k]
        up[a:b] = np.where(k < len(turn), part[at] < part[at + 1], later)
        later = bool(up[a])
    return up


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of suffixes a[i] and b[i], depth at most."""
    out, live, n = np.zeros(len(a), np.uint8), np.arange(len(a)), len(text)
    for k in range(depth):
        live = live[(a[live] + k < n) & (b[live] + k < n)]
        live = live[text[a[live] + k] == text[b[live] + k]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def named(text: np.ndarray, up: np.ndarray, star: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """Rank of the substring of ``size`` symbols from each place (equal substrings, equal rank)."""
    per = max(1, 63 // bits)
    rank, live, upto = np.zeros(len(star), np.int64), np.arange(len(star)), 0
    while len(live):
        packed = key_of(text, up, star[live], size[live], upto, per, bits)
        order = np.lexsort((packed, rank[live]))
        r, p = rank[live][order], packed[order]
        at = np.arange(len(order))
        new_rank = np.concatenate([[True], r[1:] != r[:-1]])
        new = new_rank | np.concatenate([[True], p[1:] != p[:-1]])
        begin, begin_rank = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(new_rank, at, 0))
        rank[live[order]] = r + begin - begin_rank
        upto += per
        tied = np.zeros(len(order), bool)
        tied[1:] |= ~new[1:]
        tied[:-1] |= ~new[1:]
        live = live[order[tied]]
        live = live[size[live] > upto]
    return rank


def key_of(text: np.ndarray, up: np.ndarray, star: np.ndarray, size: np.ndarray, start: int, per: int, bits: int) -> np.ndarray:
    """Symbols and types from ``start`` on, ``per`` of them in one number; nothing after the substring's end."""
    out, n = np.zeros(len(star), np.int64), len(text)
    for k in range(start, start + per):
        at = np.minimum(star + k, n - 1)
        out = (out << bits) | np.where(k < size, (text[at].astype(np.int64) << 1) | up[at], 0)
    return out


def names(text: np.ndarray, up: np.ndarray, star: np.ndarray, memory: int) -> np.ndarray:
    """Rank of the substring from each S* place to the next, in parts dealt by the first symbols."""
    m, bits = len(star), max(1, int(text.max()).bit_length()) + 1
    per = max(1, 63 // bits)
    rank, size = array(np.int64, m, memory), array(np.int64, m, memory)
    for a in range(0, m - 1, BLOCK):
        following = star[a + 1 : a + BLOCK + 1]
        size[a : a + len(following)] = following - star[a : a + len(following)] + 1
    size[m - 1] = 1
    if m <= memory:
        rank[:] = named(text, up, np.asarray(star), np.asarray(size), bits)
        return rank
    first = array(np.int64, m, memory)
    for a in range(0, m, BLOCK):
        first[a : a + BLOCK] = key_of(text, up, star[a : a + BLOCK], size[a : a + BLOCK], 0, per, bits)
    sample = np.sort(first[:: max(1, m // 4096)])
    parts = -(-2 * m // memory)
    cuts = np.unique(sample[[len(sample) * k // parts for k in range(1, parts)]])
    before = 0
    for k in range(len(cuts) + 1):
        own = np.concatenate([a + np.flatnonzero(np.searchsorted(cuts, first[a : a + BLOCK], "right") == k) for a in range(0, m, BLOCK)])
        if len(own):
            rank[own] = before + named(text, up, star[own], size[own], bits)
        before += len(own)
    return rank


def doubled(text: np.ndarray, depth: int | None) -> np.ndarray:
    """Suffixes of a short text in order (to ``depth`` symbols), by prefix doubling."""
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        order = np.argsort(rank, kind="stable")
        if k >= n or (depth is not None and k >= depth) or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        k *= 2


class LeastBetween:
    """Least value of any stretch of a block."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over [a, b], b >= a."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.uint8)
        for k, values in enumerate(self.levels):
            own = np.flatnonzero(level == k)
            if len(own):
                out[own] = np.minimum(values[a[own]], values[b[own] - (1 << k) + 1])
        return out


class Inducer:
    """Reads suffixes in one direction and queues the predecessors of one type."""

    def __init__(self, text: np.ndarray, up: np.ndarray, rising_type: bool, n_symbols: int, depth: int, memory: int):
        self.text, self.up, self.kind, self.depth = text, up, rising_type, depth
        self.queue = DiskQueue(memory)
        self.least = np.zeros(n_symbols, np.uint8)  # since the symbol's last tuple; 0 before its first

    def read(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        shared = rows["shared"]
        at = np.flatnonzero(rows["place"] > 0)
        before = rows["place"][at] - 1
        own = self.up[before] == self.kind
        at, before = at[own], before[own]
        symbol = self.text[before].astype(np.int64)
        order = np.argsort(symbol, kind="stable")
        at, before, symbol = at[order], before[order], symbol[order]
        new = np.concatenate([[True], symbol[1:] != symbol[:-1]]) if len(symbol) else np.zeros(0, bool)
        since = np.where(new, 0, np.concatenate([[0], at[:-1] + 1])[: len(at)])
        between = LeastBetween(shared)
        low = between(since, at)
        low = np.where(new, np.minimum(low, self.least[symbol]), low)
        out = np.empty(len(at), ROW)
        out["place"], out["shared"] = before, np.minimum(low.astype(np.int64) + 1, self.depth)
        if len(at):
            first = np.flatnonzero(new)
            out["shared"][first[self.fresh(symbol[first])]] = 0
            last = np.append(first[1:], len(at)) - 1
            np.minimum(self.least, shared.min(), out=self.least)
            tail = at[last] + 1
            inside = tail < len(shared)
            rest = np.full(len(last), 255, np.uint8)
            rest[inside] = between(tail[inside], np.full(int(inside.sum()), len(shared) - 1))
            self.least[symbol[last]] = rest
            self.queue.put(symbol, out)
        else:
            np.minimum(self.least, shared.min(), out=self.least)

    def fresh(self, symbols: np.ndarray) -> np.ndarray:
        """Which of the symbols have no tuple yet."""
        if not hasattr(self, "known"):
            self.known = np.zeros(len(self.least), bool)
        out = ~self.known[symbols]
        self.known[symbols] = True
        return out


def starred(text: np.ndarray, up: np.ndarray, memory: int) -> np.ndarray:
    """The S* places."""
    found = [a + np.flatnonzero(up[a : a + BLOCK] & ~up[a - 1 : min(len(text), a + BLOCK) - 1]) for a in range(1, len(text), BLOCK)]
    out = array(np.int64, sum(map(len, found)), memory)
    return np.concatenate(found, out=out) if len(out) else out


def star_order(text: np.ndarray, up: np.ndarray, star: np.ndarray, memory: int, internal: int) -> np.ndarray:
    """Numbers of the S* places in ascending order of their suffixes."""
    m = len(star)
    if m == 1:
        return np.zeros(1, np.int64)
    rank, seen = names(text, up, star, memory), array(bool, m, memory)
    seen[:] = False
    for a in range(0, m, BLOCK):
        seen[rank[a : a + BLOCK]] = True  # a rank is the number of smaller substrings
    if int(np.count_nonzero(seen)) == m:
        out = array(np.int64, m, memory)
        for a in range(0, m, BLOCK):
            out[rank[a : a + BLOCK]] = np.arange(a, min(m, a + BLOCK))
        return out
    if m <= internal:
        return doubled(np.asarray(rank), None)
    dense = array(np.int64, m, memory)
    np.cumsum(seen, out=dense)
    for a in range(0, m, BLOCK):
        rank[a : a + BLOCK] = dense[rank[a : a + BLOCK]] - 1
    return ordered(rank, memory, internal)


def runs(following: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [c, d] of symbols such that following[s] < c for each of them, or c alone."""
    n, c = len(following), 0
    while c < n:
        d, step = c + 1, 64
        while d < n and following[c] < c:
            stop = np.flatnonzero(following[d : d + step] >= c)
            if len(stop):
                d += int(stop[0])
                break
            d, step = min(n, d + step), 2 * step
        yield c, d - 1
        c = d


def within(symbol: np.ndarray) -> np.ndarray:
    """Each entry's number among equal entries of a sorted array."""
    at = np.arange(len(symbol))
    new = np.ones(len(symbol), bool)
    new[1:] = symbol[1:] != symbol[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0))


class Induction:
    """One pass over a text of names: in the order of ``symbol``, suffixes of one type come from the queue and those of ``known`` beside them."""

    def __init__(self, symbol: np.ndarray, up: np.ndarray, kind: bool, n_symbols: int, edges: np.ndarray, memory: int):
        self.symbol, self.up, self.kind, self.n = symbol, up, kind, n_symbols
        self.queue, self.edges = RangeQueue(edges, memory), edges

    def of(self, places: np.ndarray) -> np.ndarray:
        """Symbols in the pass's order."""
        s = self.symbol[places].astype(np.int64)
        return self.n - 1 - s if self.kind else s

    def read(self, places: np.ndarray) -> None:
        p = places[places > 0] - 1
        p = p[self.up[p] == self.kind]
        pairs = np.empty(len(p), PAIR)
        pairs["symbol"], pairs["place"] = self.of(p), p
        self.queue.put(pairs)

    def run(self, following: np.ndarray, known, store) -> None:
        """``known(low, high)``: (symbols, places) of the other suffixes; ``store(symbols, places)`` takes what is found."""
        for c, d in runs(following):
            stops = [int(e) for e in self.edges[np.searchsorted(self.edges, c, "right") : np.searchsorted(self.edges, d, "right")]]
            for low, high in zip([c, *stops], [*(e - 1 for e in stops), d], strict=True):
                found = self.queue.take(low, high)
                if low == high:  # a symbol may follow itself
                    while len(found):
                        store(found["symbol"], found["place"])
                        self.read(found["place"])
                        found = self.queue.take(low, high)
                    self.read(known(low, high)[1])
                    continue
                store(found["symbol"], found["place"])
                symbol, places = known(low, high)
                turn = np.argsort(np.concatenate([2 * found["symbol"], 2 * symbol + 1]), kind="stable")
                self.read(np.concatenate([found["place"], places])[turn])


def ordered(text: np.ndarray, memory: int, internal: int) -> np.ndarray:
    """All suffixes of a text of names (the last one is 0 and stands there alone), in order."""
    n, n_symbols = len(text), int(text.max()) + 1
    up = rising(text, memory)
    star = starred(text, up, memory)
    order, seeds = star_order(text, up, star, memory, internal), array(np.int64, len(star), memory)
    seed_symbol = array(np.int64, len(star), memory)
    for a in range(0, len(star), BLOCK):
        seeds[a : a + BLOCK] = star[order[a : a + BLOCK]]
        seed_symbol[a : a + BLOCK] = text[seeds[a : a + BLOCK]]
    count, below, above = np.zeros(n_symbols, np.int64), np.full(n_symbols, -1, np.int64), np.full(n_symbols, n_symbols, np.int64)
    for a in range(0, n - 1, BLOCK):
        part = np.asarray(text[a : a + BLOCK + 1])
        own, after, kind = part[:-1], part[1:], up[a : a + len(part) - 1]
        count += np.bincount(own, minlength=n_symbols)
        np.maximum.at(below, own[~kind], after[~kind])  # the largest symbol after an L suffix's first
        np.minimum.at(above, own[kind], after[kind])  # the least symbol after an S suffix's first
    count[0] += 1
    start = np.concatenate([[0], np.cumsum(count)])
    edges = np.unique(np.searchsorted(start, np.arange(1, 256) * n // 256))  # ranges of about as many suffixes
    edges = edges[(edges > 0) & (edges < n_symbols)]
    out, filled, ends = array(np.int64, n, memory), start[:-1].copy(), start[1:].copy()

    def seeds_of(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(seed_symbol, [low, high + 1])
        return seed_symbol[a:b], seeds[a:b]

    def rise(symbol: np.ndarray, place: np.ndarray) -> None:
        out[filled[symbol] + within(symbol)] = place
        np.add.at(filled, symbol, 1)

    def falling_of(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """L suffixes from the greatest symbol down, each symbol's from its last on."""
        s = n_symbols - 1 - np.arange(low, high + 1)
        many = filled[s] - start[s]
        at = np.repeat(filled[s] - 1, many) - within(np.repeat(np.arange(low, high + 1), many))
        return np.repeat(np.arange(low, high + 1), many), out[at]

    def fall(symbol: np.ndarray, place: np.ndarray) -> None:
        s = n_symbols - 1 - symbol
        out[ends[s] - 1 - within(symbol)] = place
        np.subtract.at(ends, s, 1)

    Induction(text, up, False, n_symbols, edges, memory).run(below, seeds_of, rise)
    Induction(text, up, True, n_symbols, np.sort(n_symbols - edges), memory).run(n_symbols - 1 - above[::-1], falling_of, fall)
    out[0] = n - 1
    return out


def turned(blocks: Iterable[np.ndarray], shared: int) -> Iterator[np.ndarray]:
    """Blocks, given from the last on, the other way round; ``shared`` is the first row's then."""
    for rows in blocks:
        out = rows[::-1].copy()
        out["shared"] = np.append(np.uint8(shared), rows["shared"][:0:-1])
        shared = int(rows["shared"][0])
        yield out


def sorted_suffixes(text: np.ndarray, depth: int = 50, memory: int = MEMORY, internal: int = INTERNAL) -> Iterator[np.ndarray]:
    """Blocks of (place, shared) in ascending order of the suffixes; shared: with the one before, 0 at a new first symbol.

    ``text`` holds non-negative numbers; the last is 0 and stands there alone; it is left out of the result.
    """
    n = len(text)
    if n < 2:
        return
    n_symbols, text = int(text.max()) + 1, placed(text, memory)
    up = rising(text, memory)
    star = starred(text, up, memory)
    order = star_order(text, up, star, memory, internal)
    seeds, symbols, before = array(ROW, len(star), memory), array(text.dtype, len(star), memory), None
    for a in range(0, len(star), BLOCK):
        places = star[order[a : a + BLOCK]]
        seeds["place"][a : a + BLOCK], symbols[a : a + BLOCK] = places, text[places]
        last = np.concatenate([places[:1] if before is None else before, places[:-1]])
        seeds["shared"][a : a + BLOCK] = shared_prefix(text, last, places, depth)
        before = places[-1:]
    seeds["shared"][0] = 0
    present = np.flatnonzero(np.bincount(text, minlength=n_symbols)).tolist()

    falling, kept = Inducer(text, up, False, n_symbols, depth, memory), DiskQueue(memory)
    for c in present:
        last = -1
        for rows in falling.queue.take(c):
            kept.put(np.full(len(rows), c), rows)
            falling.read(rows)
            last = int(rows["place"][-1])
        a, b = np.searchsorted(symbols, [c, c + 1])
        for k in range(a, b, BLOCK):
            own = seeds[k : min(b, k + BLOCK)].copy()
            if k == a:
                own["shared"][0] = shared_prefix(text, np.array([last]), own["place"][:1], depth)[0] if last >= 0 else 0
            falling.read(own)

    back, upper, meets = Inducer(text, up, True, n_symbols, depth, memory), DiskQueue(memory), {}
    for c in present[::-1]:
        last = -1
        for rows in back.queue.take(c):
            upper.put(np.full(len(rows), c), rows)
            back.read(rows)
            last = int(rows["place"][-1])
        greatest = next((rows["place"][-1:] for rows in kept.backwards(c)), None)
        meets[c] = int(shared_prefix(text, np.array([last]), greatest, depth)[0]) if last >= 0 and greatest is not None else 0
        for rows in turned(kept.backwards(c), meets[c]):
            back.read(rows)
    for c in present:
        if c:
            yield from kept.blocks(c)
            yield from turned(upper.backwards(c), meets[c])
