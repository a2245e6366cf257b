"""Suffix sorting with common-prefix values by recursive induction from disk-backed queues.

The order of all suffixes of a string follows from that of its S* suffixes (those that begin a rise after a fall):
scanning suffixes in ascending order, each hands its left neighbour, if that is of the falling type, on to the queue
of the neighbour's first letter; scanning back in descending order, likewise for the rising type. What arrives in the
queue of a letter is already in order, so a queue needs no sorting.

S* suffixes are ordered by the same induction. Started from S* suffixes that are told apart by their first letter only, it
orders the S* substrings; equal ones get equal names, and the string of names, shorter by half at least, is sorted by
recursion (`suffix_order`). Its letters are as many as its places, so a queue there serves a range of letters that
fits in memory, sorted when its turn comes, or one frequent letter, first in, first out. Strings of at most `memory`
letters end the recursion: they are ranked in memory, of which each round doubles the letters compared. For texts with so few
S* suffixes this is done at once.

The last induction, over bytes, has 256 queues and carries with each suffix its common prefix with the one before it in
the queue: one more than the least value between the two places that handed them over. These values stop at CAP; the order
is exact.

Texts, names, types and queues lie in files (mapped, or read block by block); about `memory` items at a time are held.

Bytes 0xFE and 0xFF are not found in UTF-8: 0xFE stands after each string, the last one too, and 0xFF pads names.
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterator

import numpy as np

CAP = 250
BREAK = 0xFE
PAD = 16  # bytes behind a text, so that eight can be read at every place
TAGGED = np.dtype([("at", "<i8"), ("tag", "<i8")])
PAIR = np.dtype([("at", "<i8"), ("tag", "u1")])


class Column:
    """Numbers appended to a file and then mapped."""

    def __init__(self, kind: np.dtype | str) -> None:
        self.kind, self.file, self.size = np.dtype(kind), tempfile.TemporaryFile(), 0  # noqa: SIM115

    def append(self, values: np.ndarray) -> None:
        self.file.seek(self.size * self.kind.itemsize)
        self.file.write(np.ascontiguousarray(values, self.kind).tobytes())
        self.size += len(values)

    def mapped(self) -> np.ndarray:
        return np.memmap(self.file, self.kind, "r", shape=(self.size,)) if self.size else np.zeros(0, self.kind)

    def block(self, i: int, j: int) -> np.ndarray:
        """Items i to j, in memory."""
        self.file.seek(i * self.kind.itemsize)
        return np.frombuffer(self.file.read((j - i) * self.kind.itemsize), self.kind)

    def blocks(self, step: int, back: bool = False) -> Iterator[np.ndarray]:
        """All items by blocks; back: from the last block to the first, each in its own order."""
        for i in range(0, self.size, step) if not back else range((self.size - 1) // step * step, -1, -step) if self.size else ():
            yield self.block(i, min(self.size, i + step))


class Queues:
    """Queues of (place, tag), together with at most so many items of memory; the older ones lie in a file that all share."""

    def __init__(self, number: int = 256, kind: np.dtype = PAIR, memory: int = 8 << 20, block: int = 1 << 18) -> None:
        self.memory, self.block, self.held, self.kind = memory, block, 0, kind
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(number)]
        self.runs = [array("q") for _ in range(number)]  # of what is in the file: first item, end, first item, end, ...
        self.file, self.spilled = None, 0

    def push(self, queue: int, at: np.ndarray, tag: np.ndarray) -> None:
        self.parts[queue].append((at, tag))
        self.held += len(at)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(buffering=0)  # noqa: SIM115
        for queue, parts in enumerate(self.parts):
            if parts:
                rows = np.empty(sum(len(at) for at, _ in parts), self.kind)
                np.concatenate([at for at, _ in parts], out=rows["at"])
                np.concatenate([tag for _, tag in parts], out=rows["tag"], casting="unsafe")
                self.file.seek(self.spilled * self.kind.itemsize)
                self.file.write(rows.tobytes())
                self.runs[queue].extend((self.spilled, self.spilled + len(rows)))
                self.spilled += len(rows)
                parts.clear()
        self.held = 0

    def _read(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(i * self.kind.itemsize)
        rows = np.frombuffer(self.file.read((j - i) * self.kind.itemsize), self.kind)
        return rows["at"].copy(), rows["tag"].copy()

    def pop(self, queue: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest items of a queue, about a block of them."""
        parts, runs, got, n, k, r = self.parts[queue], self.runs[queue], [], 0, 0, 0
        most = most or self.block
        while r < len(runs) and n < most:
            i, j = runs[r], min(runs[r + 1], runs[r] + most - n)
            got.append(self._read(i, j))
            n += j - i
            runs[r] = j
            r += 2 * (j == runs[r + 1])
        del runs[:r]
        while k < len(parts) and n < most:
            got.append(parts[k])
            n += len(parts[k][0])
            self.held -= len(parts[k][0])
            k += 1
        del parts[:k]
        if len(got) > 1:
            return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        return got[0] if got else None

    def whole(self, queue: int) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return self.pop(queue, 1 << 62) or (none, none)

    def backwards(self, queue: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The items of a queue by parts, last part first; nothing is removed."""
        yield from reversed(self.parts[queue])
        runs = self.runs[queue]
        for r in range(len(runs) - 2, -1, -2):
            for j in range(runs[r + 1], runs[r], -self.block):
                yield self._read(max(runs[r], j - self.block), j)

    def drop(self, queue: int) -> None:
        self.held -= sum(len(at) for at, _ in self.parts[queue])
        self.parts[queue] = []
        self.runs[queue] = array("q")


def by_place(queues: Queues, at: np.ndarray, tag: np.ndarray, width: int) -> None:
    """Deals items out by ranges of `width` places."""
    if not len(at):
        return
    own = at // width
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    for part in np.split(order, cuts):
        queues.push(int(own[part[0]]), at[part], tag[part])


class Minima:
    """Least values of ranges of a block, by a table of doubling ranges."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            v = self.levels[-1]
            self.levels.append(np.minimum(v[:-width], v[width:]))
            width *= 2
        self.flat = np.concatenate(self.levels)
        self.offsets = np.cumsum([0, *(len(v) for v in self.levels[:-1])])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over first..last, both included; CAP where that is empty."""
        n = last - first + 1
        some = n > 0
        k = np.frexp(np.maximum(n, 1).astype(np.float64))[1].astype(np.int64) - 1
        base = self.offsets[k]
        a = np.where(some, first, 0)
        return np.where(some, np.minimum(self.flat[base + a], self.flat[base + np.where(some, last - (1 << k) + 1, 0)]), CAP)


# ---- in memory


def _words(text: np.ndarray) -> np.ndarray:
    """A view of the eight bytes at every place as one big-endian number. text: padded by 8 at least."""
    return np.ndarray((len(text) - 7,), ">u8", text.data, 0, (1,))


def _refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> None:
    """Splits groups of equal rank by key, in place. active: all members of the groups concerned; a rank is the number of members before its group."""
    r = rank[active]
    if key.dtype == np.int64 and len(rank) < 1 << 31:  # ranks and keys of 32 bits: one number
        order = np.argsort(r.astype(np.uint64) << np.uint64(32) | (key + 1).astype(np.uint64))
    else:
        order = np.lexsort((key, r)) if r.any() else np.argsort(key)
    r, k, who = r[order], key[order], active[order]
    place = np.arange(len(who))
    group = np.concatenate([[True], r[1:] != r[:-1]])
    inner = group | np.concatenate([[True], k[1:] != k[:-1]])
    rank[who] = r + np.maximum.accumulate(np.where(inner, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))


def _doubled(rank: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of a string of letters, given the letters' ranks (with ties)."""
    m, names = len(rank), 1
    while True:
        active = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
        if not len(active):
            return rank
        later = active + names
        _refine(rank, active, np.where(later < m, rank[np.minimum(later, m - 1)], -1))
        names *= 2


def stars(text: np.ndarray, n: int) -> np.ndarray:
    """The places of the S* suffixes."""
    t = text[:n]
    edge = np.flatnonzero(t[1:] != t[:-1])  # last places of runs
    if not len(edge):
        return np.zeros(0, np.int64)
    up = t[edge + 1] > t[edge]
    # a run that rises, after a run that is higher
    return edge[:-1][up[1:] & ~up[:-1]] + 1


def sorted_stars(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The S* suffixes (places `at`, ascending) in order, in memory: their substrings by eight bytes at a time, then the names by doubling."""
    m = len(at)
    if not m:
        return at
    words = _words(text)
    length = np.append(at[1:], n - 1) - at + 1

    def chunk(who: np.ndarray, j: int) -> np.ndarray:
        left = np.clip(length[who] - 8 * j, 0, 8).astype(np.uint64)
        fill = np.where(left == 8, np.uint64(0), np.uint64(2**64 - 1) >> (np.minimum(left, np.uint64(7)) * np.uint64(8)))
        fill[who == m - 1] = 0  # what follows the last one is the end, smaller than any byte
        return words[np.minimum(at[who] + 8 * j, len(words) - 1)].astype(np.uint64) | fill

    rank = np.zeros(m, np.int64)
    _refine(rank, np.arange(m), chunk(np.arange(m), 0))
    live, j = np.arange(m), 1
    while len(live := live[length[live] > 8 * j]):
        has = np.zeros(m, bool)
        has[rank[live]] = True
        active = np.flatnonzero(has[rank] & (np.bincount(rank, minlength=m)[rank] > 1))
        if not len(active):
            break
        _refine(rank, active, chunk(active, j))
        j += 1
    return at[np.argsort(_doubled(rank))]


def common_prefixes(text: np.ndarray, at: np.ndarray, before: int | None) -> np.ndarray:
    """Each place's common prefix with the one before it, up to CAP; before: the place before the first, if there is one."""
    words = _words(text)
    prior = np.concatenate([[at[0] if before is None else before], at[:-1]])
    lcp = np.zeros(len(at), np.int64)
    live = np.arange(before is None, len(at))
    for j in range(0, CAP, 8):
        if not len(live):
            break
        x = words[np.minimum(at[live] + j, len(words) - 1)].astype(np.uint64) ^ words[np.minimum(prior[live] + j, len(words) - 1)].astype(np.uint64)
        lcp[live] = j + sum((x < (np.uint64(1) << np.uint64(8 * b))).astype(np.int64) for b in range(8))
        live = live[x == 0]
    return np.minimum(lcp, CAP).astype(np.uint8)


# ---- recursion, on disk


def falling_types(letters: np.ndarray, block: int) -> np.ndarray:
    """Whether each suffix is of the falling type (greater than the next one), found from the end."""
    n = len(letters)
    out = np.memmap(tempfile.TemporaryFile(), bool, "w+", shape=(n,))
    next_letter, next_falls = -1, True
    for i in range((n - 1) // block * block, -1, -block):
        t = np.asarray(letters[i : i + block]).astype(np.int64)
        after = np.append(t[1:], next_letter)
        falls = t > after
        same = t == after
        if same.any():  # equal letters follow the type of the next other one
            other = np.where(same, len(t), np.arange(len(t)))
            other = np.minimum.accumulate(other[::-1])[::-1]
            falls = np.append(falls, next_falls)[other]
        out[i : i + block] = falls
        next_letter, next_falls = int(t[0]), bool(falls[0])
    return out


def _ranges(letters: np.ndarray, memory: int, block: int) -> np.ndarray:
    """The edges of ranges of letters with at most `memory` places each, but for letters that alone have more."""
    most = 0
    for i in range(0, len(letters), block):
        most = max(most, int(np.max(letters[i : i + block])))

    def split(low: int, high: int) -> list[int]:
        """Cuts of low..high: counted in bins of letters, and again in those bins that are too full."""
        bins = min(1 << 12, high - low + 1)
        width = -(-(high - low + 1) // bins)
        n = np.zeros(bins, np.int64)
        for i in range(0, len(letters), block):
            t = np.asarray(letters[i : i + block]).astype(np.int64)
            n += np.bincount((t[(t >= low) & (t <= high)] - low) // width, minlength=bins)[:bins]
        cuts, held = [low], 0
        for k in range(bins):
            first = low + k * width
            if first > high:
                break
            if n[k] > memory:
                cuts += [first, *(split(first, min(high, first + width - 1)) if width > 1 else ()), first + width]
                held = 0
                continue
            if held and held + n[k] > memory:
                cuts.append(first)
                held = 0
            held += int(n[k])
        return [c for c in dict.fromkeys(cuts) if c <= high]

    return np.array([*split(0, most), most + 1], np.int64)


class _Induction:
    """One string's inductions. A tag is a number that grows along the scan, equal for what is not told apart."""

    def __init__(self, letters: np.ndarray, memory: int, block: int) -> None:
        self.letters, self.n, self.memory, self.block = letters, len(letters), memory, block
        self.falls = falling_types(letters, block)
        edges = _ranges(letters, max(1, memory // 4), block)  # what is ranked at once takes several numbers a place
        self.first, self.last = edges[:-1], edges[1:]

    def stars(self) -> Column:
        out, before = Column("<i8"), False
        for i in range(0, self.n, self.block):
            falls = np.asarray(self.falls[i : i + self.block])
            out.append(i + np.flatnonzero(~falls & np.concatenate([[before], falls[:-1]])))
            before = bool(falls[-1])
        return out

    def letter(self, at: np.ndarray) -> np.ndarray:
        return np.asarray(self.letters[at]).astype(np.int64)

    def queues(self) -> Queues:
        return Queues(len(self.first), TAGGED, self.memory, self.block)

    def deal(self, queues: Queues, at: np.ndarray, tag: np.ndarray) -> None:
        """To the queues of the ranges of the places' letters, in order."""
        if len(at):
            own = np.searchsorted(self.first, self.letter(at), "right") - 1
            order = np.argsort(own, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                queues.push(int(own[part[0]]), at[part], tag[part])

    def run(self, seeds: Queues, falling: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Scans the ranges, ascending for the falling type, descending for the rising one; gives (range, places, tags, which are seeds) in order.

        Seeds of a letter come after its other suffixes: the S* suffixes in ascending order, or the falling ones in descending order.
        """
        arrived = self.queues()
        if falling:  # the end, smaller than all, hands on the last place
            self.deal(arrived, np.array([self.n - 1]), np.array([-1]))
        base = 0
        for r in range(len(self.first)) if falling else range(len(self.first) - 1, -1, -1):
            low, high = int(self.first[r]), int(self.last[r])
            scan = self._one(r, arrived, seeds, falling, base) if high - low == 1 else self._several(low, high, r, arrived, seeds, falling, base)
            for at, tag, is_seed in scan:
                before = at[at > 0] - 1
                tags = tag[at > 0]
                goes = np.asarray(self.falls[before]) == falling
                letter = self.letter(before)
                goes &= (letter >= high) if falling else (letter < low)
                self.deal(arrived, before[goes], tags[goes])
                base = int(tag[-1]) + 1
                yield r, at, tag, is_seed
            arrived.drop(r)

    def _one(self, r: int, arrived: Queues, seeds: Queues, falling: bool, base: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A range of one letter: first in, first out; then its seeds."""
        letter = int(self.first[r])
        for queue in (arrived, seeds):
            last = None
            while (got := queue.pop(r)) is not None:
                at, tag = got
                new = np.concatenate([[last is None or tag[0] != last], tag[1:] != tag[:-1]])
                last = int(tag[-1])
                own = base - 1 + np.cumsum(new)
                base = int(own[-1]) + 1
                yield at, own, np.full(len(at), queue is seeds)
                base = int(own[-1])  # the next block may go on with the same tag
                if queue is arrived:
                    before, tags = at[at > 0] - 1, own[at > 0]
                    goes = (np.asarray(self.falls[before]) == falling) & (self.letter(before) == letter)
                    if goes.any():
                        queue.push(r, before[goes], tags[goes])
                base += 1

    def _several(self, low: int, high: int, r: int, arrived: Queues, seeds: Queues, falling: bool, base: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A range in memory: all that its own suffixes hand on inside it is found first, then everything is ranked at once."""
        came, came_tag = arrived.whole(r)
        seed, seed_tag = seeds.whole(r)
        parts, source, begin = [came, seed], [np.arange(len(came)), len(came) + np.arange(len(seed))], 0
        new = np.concatenate([came, seed])
        size = len(new)
        index = np.arange(size)
        while len(new):
            has = new > 0
            before, by = new[has] - 1, index[has]
            letter = self.letter(before)
            goes = (np.asarray(self.falls[before]) == falling) & (letter >= low) & (letter < high)
            new, by = before[goes], by[goes]
            index = size + np.arange(len(new))
            size += len(new)
            parts.append(new)
            source.append(by)
        at, nxt = np.concatenate(parts), np.concatenate(source)
        if not size:
            return
        letter = self.letter(at)
        key = letter if falling else -letter
        kind = np.full(size, 1)
        kind[: len(came)], kind[len(came) : len(came) + len(seed)] = 0, 2
        tag = np.zeros(size, np.int64)
        tag[: len(came)], tag[len(came) : len(came) + len(seed)] = came_tag, seed_tag
        rank = _dense(key, kind, tag)
        while True:  # each round doubles the steps of the chains that are compared
            more = _dense(rank, rank[nxt])
            if more.max() == rank.max():
                break
            rank, nxt = more, nxt[nxt]
        order = np.argsort(rank, kind="stable")
        yield at[order], base + rank[order], kind[order] == 2


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks, counted without gaps, by several keys; equal ones share theirs."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _both(induction: _Induction, seeds: Queues) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order with their tags, from seeds that are the S* suffixes."""
    falls, ends = Column(TAGGED), {}  # the ranges' falling suffixes one after the other, and where each range's end
    for r, at, tag, is_seed in induction.run(seeds, True):
        rows = np.empty(int((~is_seed).sum()), TAGGED)
        rows["at"], rows["tag"] = at[~is_seed], tag[~is_seed]
        ends.setdefault(r, [falls.size, falls.size])
        falls.append(rows)
        ends[r][1] = falls.size

    class Back(Queues):
        """The falling suffixes of a range, last first, as seeds of the scan back."""

        def pop(self, queue: int, most: int | None = None):
            low, j = ends.get(queue, (0, 0))
            if low == j:
                return None
            i = low if most is not None else max(low, j - induction.block)
            ends[queue][1] = i
            rows = falls.block(i, j)[::-1]
            return rows["at"].copy(), -rows["tag"]

    for _, at, tag, _ in induction.run(Back(0), False):
        yield at, tag


def star_order(letters: np.ndarray, memory: int, block: int) -> Column:
    """The S* suffixes in ascending order."""
    induction = _Induction(letters, memory, block)
    at = induction.stars()
    m = at.size
    out = Column("<i8")
    if not m:
        return out
    seeds = induction.queues()
    for part in at.blocks(block):  # told apart by their first letters only
        induction.deal(seeds, part, induction.letter(part))
    width = max(1, -(-induction.n * memory // (4 * m)) if m > memory else induction.n)
    named, kinds, last = Queues(-(-induction.n // width), TAGGED, memory, block), 0, None
    found = Column("<i8")
    for place, tag in _both(induction, seeds):
        star = (place > 0) & ~np.asarray(induction.falls[place]) & np.asarray(induction.falls[np.maximum(place - 1, 0)])
        place, tag = place[star], tag[star]
        if len(place):
            new = np.concatenate([[tag[0] != last], tag[1:] != tag[:-1]])
            last = int(tag[-1])
            name = kinds - 1 + np.cumsum(new)
            kinds = int(name[-1]) + 1
            by_place(named, place, name, width)
            found.append(place)
    if kinds == m:
        for part in found.blocks(block, back=True):
            out.append(part[::-1])
        return out
    names = Column("<i8")
    for queue in range(len(named.parts)):
        place, name = named.whole(queue)
        names.append(kinds - 1 - name[np.argsort(place)])
    places = at.mapped()
    for part in suffix_order(names.mapped(), memory, block).blocks(block):
        out.append(np.asarray(places[part]))
    return out


def suffix_order(letters: np.ndarray, memory: int, block: int) -> Column:
    """All suffixes of a string of numbers from 0 on, in ascending order."""
    out = Column("<i8")
    if len(letters) <= memory:
        out.append(np.argsort(_doubled(_tied(np.asarray(letters)))))
        return out
    induction = _Induction(letters, memory, block)
    seeds, n = induction.queues(), 0
    for part in star_order(letters, memory, block).blocks(block):
        induction.deal(seeds, part, n + np.arange(len(part)))
        n += len(part)
    descending = Column("<i8")
    for at, _ in _both(induction, seeds):
        descending.append(at)
    for part in descending.blocks(block, back=True):
        out.append(part[::-1])
    return out


def _tied(letters: np.ndarray) -> np.ndarray:
    """Ranks of letters: the number of places with a smaller one."""
    order = np.argsort(letters, kind="stable")
    t = letters[order]
    rank = np.empty(len(t), np.int64)
    rank[order] = np.searchsorted(t, t)
    return rank


# ---- the last induction, over bytes


class _Scan:
    """Hands suffixes of a scanned sequence on to the queues of their left neighbours' bytes."""

    def __init__(self, text: np.ndarray, queues: Queues) -> None:
        self.text, self.queues = text, queues
        self.since = np.full(256, CAP, np.int64)  # least value since the last item for a queue
        self.begun = np.zeros(256, bool)

    def __call__(self, at: np.ndarray, lcp: np.ndarray, least: int, most: int) -> None:
        """at, lcp: the next suffixes of the scan. Neighbours with a byte from least to most are handed on."""
        for i in range(0, len(at), self.queues.block):
            self._block(at[i : i + self.queues.block], lcp[i : i + self.queues.block], least, most)

    def _block(self, at: np.ndarray, lcp: np.ndarray, least: int, most: int) -> None:
        byte = np.asarray(self.text[at - 1])  # at 0: some other byte, left out below
        goes = np.flatnonzero((byte >= least) & (byte <= most) & (at > 0))
        low = int(lcp.min())
        if not len(goes):
            np.minimum(self.since, low, out=self.since)
            return
        b = byte[goes]
        order = np.argsort(b, kind="stable")
        j, b = goes[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        minima = Minima(lcp)
        begin = np.empty_like(j)
        begin[1:] = j[:-1] + 1
        begin[first] = 0
        value = minima(begin, j).astype(np.int64)
        heads = b[first].astype(np.int64)
        value[first] = np.minimum(value[first], self.since[heads])
        value = np.minimum(value + 1, CAP)
        value[first[~self.begun[heads]]] = 0
        ends = np.append(first[1:], len(j))
        np.minimum(self.since, low, out=self.since)
        tail = j[ends - 1] + 1
        self.since[heads] = minima(tail, np.full(len(tail), len(lcp) - 1))
        self.begun[heads] = True
        value = value.astype(np.uint8)
        new = at[j] - 1
        for h, i, k in zip(heads.tolist(), first.tolist(), ends.tolist(), strict=True):
            self.queues.push(h, new[i:k], value[i:k])


def _run(text: np.ndarray, at: int, byte: int) -> int:
    """How often the byte stands from a place on, up to CAP."""
    other = np.flatnonzero(text[at : at + CAP] != byte)
    return int(other[0]) if len(other) else CAP


def ordered_stars(text: np.ndarray, n: int, memory: int, block: int) -> Iterator[np.ndarray]:
    """The S* suffixes of a text in order, by blocks."""
    if n <= 4 * memory:  # of which about a third are S*, at most half
        order = sorted_stars(np.asarray(text), stars(np.asarray(text), n), n)
        for i in range(0, len(order), block):
            yield order[i : i + block]
    else:
        yield from star_order(text[:n], memory, block).blocks(block)


def descending(text: np.ndarray, n: int, memory: int = 8 << 20, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of the first n bytes of a text (PAD zeros behind them) in descending order, and each one's common prefix with the one before it in that order."""
    if not n:
        return
    falling, scanned = Queues(256, PAIR, memory, block), Queues(256, PAIR, memory, block)
    scan = _Scan(text, falling)
    scan(np.array([n]), np.zeros(1, np.uint8), 0, 255)  # the empty suffix is the smallest
    star = ordered_stars(text, n, memory, block)
    held = next(star, None)
    for byte in range(256):
        last = None
        begun = False
        while (got := falling.pop(byte)) is not None:
            at, lcp = got
            if not begun:
                lcp[0], begun = 0, True
            scan(at, lcp, byte, 255)
            scanned.push(byte, at, lcp)
            last = int(at[-1])
        before = None
        while held is not None and text[held[0]] == byte:
            k = int(np.searchsorted(np.asarray(text[held]), byte, "right"))
            at, held = held[:k], held[k:] if k < len(held) else next(star, None)
            lcp = common_prefixes(text, at, before)
            if before is None:
                lcp[0] = 0 if last is None else min(_run(text, last, byte), _run(text, int(at[0]), byte))
            scan(at, lcp, byte + 1, 255)
            before = int(at[-1])
    rising = Queues(256, PAIR, memory, block)
    scan = _Scan(text, rising)
    for byte in range(255, -1, -1):
        last = None
        while (got := rising.pop(byte)) is not None:
            at, lcp = got
            if last is None:
                lcp[0] = 0
            scan(at, lcp, 0, byte)
            yield at, lcp
            last = int(at[-1])
        value = None
        for at, lcp in scanned.backwards(byte):  # parts in descending order; a part's first value is with the last of the part before it
            if value is None:
                value = 0 if last is None else min(_run(text, last, byte), _run(text, int(at[-1]), byte))
            back = np.concatenate([np.array([value], np.uint8), lcp[:0:-1]])
            scan(at[::-1], back, 0, byte - 1)
            value = int(lcp[0])
            yield at[::-1], back
        scanned.drop(byte)
