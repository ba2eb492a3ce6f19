"""Blocks of token ids, coded by an adaptive range coder that mixes predictions of order 0 to 2.

A block is cut into strips of equal length that are coded side by side, one id of each strip per
step, each strip with a range coder of its own and all with one model that learns from every strip
after each step. The model holds

- order 2: for a hash of the two ids before, the id that mostly follows and how sure that is;
- order 1: for the id before, NEXT ids that follow it with their counts, and how often they serve;
- order 0: the counts of all ids.

The probability of an id is the weighted sum of what the three orders give it. The weights are
adaptive: for each pair of how sure order 2 and how reliable order 1 are, counts of which order
explained the ids coded there best. In code space the ids that orders 1 and 2 name come last, each with
the whole sum of what the three orders give it; all others share what is left as order 0 has it.
A block starts from an empty model, so it can be read by itself, and holds checksums of its ids and
of its code.

Layout, little-endian: 4 bytes magic; uint32 ids, vocabulary, strips, crc32 of the ids as uint32,
crc32 of what follows; uint16 code words of each strip; the strips' code as uint32 words.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"MRC2"
HEAD = 24
BITS = 28
TOTAL = 1 << BITS
STRIPS = 4096
STRIP_IDS = 64
TABLE_BITS = 18
#: ids that follow an id, as far as order 1 remembers them
NEXT = 2
MOST = 252
#: what a count gains when its id comes, and loses when one comes that has no count
GAIN, LOSE = 4, 1
#: steps between two counts of the order-0 frequencies; at first they are counted after each step
RECOUNT, EAGER = 8, 4
FLOOR = 64
_WORD = np.uint64(32)
_SPAN = np.uint64(1 << 32)
#: what an entry of order 2 gains for each certainty if it was wrong (it loses), then if it was right
_SURER = np.array([-(c + 1 >> 1) for c in range(8)] + [1] * 7 + [0], np.int32)


class BlockError(ValueError):
    """A block that can't be read: cut short, changed, or not of this format."""


class _Model:
    def __init__(self, vocabulary: int):
        self.v = vocabulary
        # entry: predicted id * 8 + how sure it is
        self.two = np.zeros(1 << TABLE_BITS, np.int32)
        # entry: id * 256 + count
        self.next = np.zeros((NEXT, vocabulary + 1), np.int32)
        self.serves = np.zeros(vocabulary + 1, np.int32)
        self.counts = np.zeros(vocabulary, np.int64)
        self.floor = FLOOR * np.arange(1, vocabulary + 1)
        self.cum = np.zeros(vocabulary + 1, np.int64)
        self.own, self.room = np.zeros(vocabulary, np.float32), np.zeros(vocabulary, np.int64)
        self.seen = np.tile(np.array([8, 1, 1, 1], np.int64), 64)
        self.recount()
        self.share()

    def recount(self) -> None:
        room = TOTAL - FLOOR * self.v
        total = int(self.counts.sum())
        # rounded down twice; what that leaves goes to the last id; in place, as arrays of the vocabulary's size are dear to make
        sums = self.room
        if total:
            np.cumsum(self.counts, out=sums)
            sums *= (room << 20) // total
            sums >>= 20
        else:
            sums[:] = np.arange(1, self.v + 1) * (room // self.v)
        np.add(self.floor, sums, out=self.cum[1:])
        self.cum[-1] = TOTAL
        # up to an eighth: what all ids that aren't named share can't get too small for the rarest
        np.subtract(self.cum[1:], self.cum[:-1], out=sums)
        self.own[:] = np.minimum(sums, TOTAL // 8, out=sums)

    def share(self) -> None:
        """Code space of the orders for each pair of order 2's and order 1's certainties."""
        none, one, two, both = self.seen.reshape(-1, 4).T
        # what both explained is shared out evenly
        part = np.stack([2 * none, 2 * one + both, 2 * two + both])
        part = (part * (TOTAL - TOTAL // 32) // part.sum(0)).astype(np.int32)
        self.zero = ((TOTAL // 32 + part[0]) / TOTAL).astype(np.float32)
        # as floats, whose quotients are exact here once rounded down, and faster than those of whole numbers
        self.one, self.sure = part[1].astype(np.float64), part[2]

    def look(self, before: np.ndarray, before2: np.ndarray) -> None:
        """The named ids of each strip with their code space, and what is left for all others."""
        slot = before2 * 0x9E3779B1
        slot += before * 0x85EBCA6B
        slot &= 0xFFFFFFFF
        slot >>= 32 - TABLE_BITS
        self.before, self.slot = before, slot
        self.two_now, self.serves_now = self.two.take(slot), self.serves.take(before)
        self.next_now = [row.take(before) for row in self.next]
        self.context = context = ((self.two_now & 7) * 8 + (self.serves_now >> 5)).astype(np.intp)
        zero = self.zero.take(context)
        counts = [e & 255 for e in self.next_now]
        unit = (self.one.take(context) / np.maximum(sum(counts[1:], counts[0]), 1)).astype(np.int32)
        two, told = self.two_now >> 3, self.sure.take(context)
        self.ids = [e >> 8 for e in self.next_now] + [two]
        self.space = []
        # an id has the sum of what orders 0, 1 and 2 give it; what both name has its space once
        twice = None
        for named, count in zip(self.ids, counts, strict=False):
            same = named == two
            twice = same if twice is None else twice | same
            self.space.append((self.own.take(named) * zero).astype(np.int32) + count * unit + told * same)
        self.space.append(((self.own.take(two) * zero).astype(np.int32) + told) * ~twice)
        self.rest = TOTAL - sum(self.space[1:], self.space[0])

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each id in its strip's code space; and remembers who named it."""
        self.hits = [ids == x for ids in self.ids]
        # as if nobody named an id, then in place of that where somebody did
        rest, at = self.rest.astype(np.int64), np.int64(TOTAL)
        start = self.cum.take(x) * rest >> BITS
        length = (self.cum[1:].take(x) * rest >> BITS) - start
        for hit, space in zip(reversed(self.hits), reversed(self.space), strict=True):
            at = at - space
            start, length = np.where(hit, at, start), np.where(hit, space, length)
        return start, length

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the given places of code space."""
        low, found = self.rest, self.ids[0]
        rest = (at < low).nonzero()[0]
        for ids, space in zip(self.ids[1:], self.space, strict=False):
            low = low + space
            found = np.where(at >= low, ids, found)
        # in order of their places, which makes the search several times as fast
        place = np.sort((((at.take(rest) + 1) << BITS) - 1) // self.rest.take(rest) << 13 | np.arange(len(rest)))
        found[rest.take(place & 8191)] = np.searchsorted(self.cum, place >> 13, "right") - 1
        return found

    def learn(self, x: np.ndarray, step: int, done) -> None:
        before, two, told = self.before, self.two_now, self.hits[-1]
        known = self.hits[0]
        for hit in self.hits[1:-1]:
            known = known | hit
        self.seen += np.bincount(self.context * 4 + (known.view(np.int8) + told.view(np.int8) * 2), minlength=len(self.seen))
        sure = two & 7
        self.two[self.slot] = np.where(told | (sure > 1), two + _SURER.take(sure + told * np.int32(8)), x * 8 + 1)
        for row, now, hit in zip(self.next, self.next_now, self.hits[:-1], strict=True):
            k = hit.nonzero()[0]
            more = now.take(k)
            row[before.take(k)] = more + np.where((more & 255) < MOST, GAIN, 0).astype(np.int32)
        self.serves[before] = self.serves_now + (known * np.int32(MOST) - self.serves_now >> 4)
        # an id that order 1 doesn't name takes the place of one that is rare, or makes it rarer
        k = (~known).nonzero()[0]
        turn = step % NEXT
        now = self.next_now[turn].take(k)
        self.next[turn][before.take(k)] = np.where((now & 255) <= LOSE, x.take(k) * 256 + GAIN, now - LOSE)
        if step < EAGER or step % RECOUNT == RECOUNT - 1:
            self.counts += np.bincount(done(1 if step < EAGER else RECOUNT - EAGER if step == RECOUNT - 1 else RECOUNT), minlength=self.v)
            self.recount()
            self.share()
            if self.seen.max() > 1 << 22:
                self.seen = np.maximum(self.seen >> 1, 1)


def _shape(n: int) -> tuple[int, int, np.ndarray]:
    """Strips, steps (up to 2**15), and how many strips have an id left at each step."""
    strips = max(1, min(STRIPS, n // STRIP_IDS), -(-n >> 15))
    steps = -(-n // strips)
    return strips, steps, np.minimum(strips, -(-(n - np.arange(steps)) // max(steps, 1)))


def _last(grid: np.ndarray, live: np.ndarray, step: int):
    """The ids of the last few steps up to `step`."""
    return lambda n: np.concatenate([grid[s, : live[s]] for s in range(step - n + 1, step + 1)])


def encode(ids: np.ndarray, vocabulary: int | None = None) -> bytes:
    """The block of ids (at most 2**21 different ones: FLOOR * vocabulary stays below TOTAL)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    v = int(vocabulary or (ids.max() + 1 if n else 1))
    if v * FLOOR * 2 > TOTAL or n and int(ids.max()) >= v:
        raise ValueError("ids are beyond the vocabulary, or the vocabulary is too large")
    strips, steps, live = _shape(n)
    grid = np.zeros(strips * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(strips, steps).T)
    model = _Model(v)
    low, span = np.zeros(strips, np.uint64), np.full(strips, (1 << 64) - 1, np.uint64)
    code, used = np.zeros((strips, steps + 2), np.uint32), np.ones(strips, np.int64)
    before, before2 = np.full(strips, v, np.int64), np.full(strips, v, np.int64)
    for t in range(steps):
        a = int(live[t])
        x, b = grid[t, :a], before[:a]
        model.look(b, before2[:a])
        start, length = model.interval(x)
        unit = span[:a] >> np.uint64(BITS)
        lo = low[:a] + unit * start.view(np.uint64)
        sp = unit * length.view(np.uint64)
        over = (lo < low[:a]).nonzero()[0]
        if len(over):
            _carry(code, used, over)
        out = (sp < _SPAN).nonzero()[0]
        word = lo[out]
        code[out, used[out]] = word >> _WORD
        used[out] += 1
        lo[out] = word << _WORD
        sp[out] <<= _WORD
        low[:a], span[:a] = lo, sp
        model.learn(x, t, _last(grid, live, t))
        before2[:a] = b
        before[:a] = x
    # one word says enough: a multiple of 2**32 in the interval; what follows is read as zeros
    end = low + np.uint64(0xFFFFFFFF)
    _carry(code, used, np.flatnonzero(end < low))
    code[np.arange(strips), used] = end >> _WORD
    used += 1
    # the first word of a strip only takes what is carried, and nothing is
    used = used - 1 if n else used[:0]
    words = code[:, 1:][np.arange(code.shape[1] - 1)[None, :] < used[:, None]] if n else code[:0, 0]
    body = used.astype("<u2").tobytes() + words.astype("<u4").tobytes()
    return MAGIC + np.array([n, v, len(used), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)], "<u4").tobytes() + body


def _carry(code: np.ndarray, used: np.ndarray, strips: np.ndarray) -> None:
    """Add one to the last word of each of the strips, and to the word before where that one wraps."""
    place = used[strips] - 1
    while len(strips):
        code[strips, place] += np.uint32(1)
        wrapped = code[strips, place] == 0
        strips, place = strips[wrapped], place[wrapped] - 1


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; BlockError where its checksums don't hold."""
    if len(block) < HEAD or block[:4] != MAGIC:
        raise BlockError("not a block")
    n, v, strips, ids_crc, body_crc = (int(x) for x in np.frombuffer(block, "<u4", 5, 4))
    if zlib.crc32(block[HEAD:]) != body_crc:
        raise BlockError("the code was changed or cut short")
    if not n:
        return np.zeros(0, np.uint32)
    _, steps, live = _shape(n)
    used = np.frombuffer(block, "<u2", strips, HEAD).astype(np.int64)
    words = np.append(np.frombuffer(block, "<u4", offset=HEAD + 2 * strips), np.uint32(0)).astype(np.uint64)
    stop = np.cumsum(used)
    place, end = stop - used, len(words) - 1
    model = _Model(v)
    span = np.full(strips, (1 << 64) - 1, np.uint64)
    # how far the code is above the interval's low end
    above = (words[place] << _WORD) | words[np.where(used > 1, place + 1, end)]
    place = place + 2
    grid = np.zeros((steps, strips), np.int32)
    before, before2 = np.full(strips, v, np.int64), np.full(strips, v, np.int64)
    for t in range(steps):
        a = int(live[t])
        b = before[:a]
        model.look(b, before2[:a])
        unit = span[:a] >> np.uint64(BITS)
        at = np.minimum(above[:a] // unit, np.uint64(TOTAL - 1)).view(np.int64)
        x = np.minimum(model.find(at), np.int32(v - 1))
        start, length = model.interval(x)
        up = above[:a] - unit * start.view(np.uint64)
        sp = unit * length.view(np.uint64)
        out = (sp < _SPAN).nonzero()[0]
        up[out] = (up[out] << _WORD) | words[np.where((own := place[out]) < stop[out], own, end)]
        place[out] = own + 1
        sp[out] <<= _WORD
        above[:a], span[:a] = up, sp
        grid[t, :a] = x
        model.learn(x, t, _last(grid, live, t))
        before2[:a] = b
        before[:a] = x
    ids = grid.T.ravel()[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise BlockError("the ids don't have the block's checksum")
    return ids
