"""A context-mixing range coder for ids, many blocks in step.

Three predictions are mixed for each id: the id that followed the two ids before it
(order 2), the one that followed the id before it (order 1), and the frequencies of
the group's ids (order 0). Orders 2 and 1 start anew in each block and say how sure
they are, from how often they were right. What each pair of such levels is worth is
counted over the group, as are the frequencies of what neither predicts; both are
written at its head, so that a block needs the head and its own words only. The mix
drives a range coder with 16-bit words. What the decoder works out is whole numbers,
so that any machine decodes what another one wrote.

The blocks of a group run in step, one lane each, so that a step is a few dozen
array operations whatever the number of lanes. When writing, the ids are known, so
that all but the followers and the ranges is worked out for many steps at once.
"""

import struct
import zlib

import numpy as np

BLOCK = 2048
LANES = 2048
MAGIC = b"IDR3"

_CONTEXTS_BITS = 10
_SURE = 7
_LEVELS = _SURE + 1
_PAIRS = 2 * _LEVELS * _LEVELS
#: Totals of the mix and of order 0, and the least that the mix leaves to order 0.
_MIX_BITS, _ZERO_BITS, _LEAST = 12, 16, 16
#: Order 0 has up to so many frequencies; of more ids, neighbours in rank share one.
_SYMBOLS_BITS = 15
_FULL = (1 << 48) - 1
_BOTTOM = 1 << 32
#: By how much an entry changes, by whether it was right and its level; ``_FRESH``: it gives way.
_FRESH = 100
_CHANGE = np.array([_FRESH] * 3 + [-((x + 1) >> 1) for x in range(3, _LEVELS)] + [1] * _SURE + [0], np.int32)
#: Steps that are prepared at once.
_AHEAD = 64
_HEAD = struct.Struct("<4sIIIII")


class _Followers:
    """Orders 1 and 2 in each lane: the id that followed a context, and how sure that is.

    An entry is ``id << 3 | level``; level 0 is a context not seen yet. Arrays have a
    row for each order, before their lanes.
    """

    def __init__(self, lanes: int, ranks: int):
        self.entries = np.zeros(2 * lanes << _CONTEXTS_BITS, _kind(ranks))
        self.base = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) << _CONTEXTS_BITS

    def slots(self, alive: int, last: np.ndarray, older: np.ndarray) -> np.ndarray:
        """Places of the contexts; ids count from 1 here, 0 is the start of a block."""
        hashed = np.empty((2, *last.shape), np.uint32)
        near, far = hashed
        np.multiply(last, np.uint32(0x9E3779B1), out=near)
        np.multiply(older, np.uint32(0xC2B2AE3D), out=far)
        far += np.uint32(0x27D4EB2F)
        far ^= near
        far *= np.uint32(0x85EBCA77)
        hashed >>= np.uint32(32 - _CONTEXTS_BITS)
        return self.base[:, None, :alive] + hashed if last.ndim > 1 else self.base[:, :alive] + hashed

    def learn(self, slot: np.ndarray, entry: np.ndarray, guess: np.ndarray, level: np.ndarray, ids: np.ndarray) -> None:
        """Take note of ``ids``. A sure entry gets less sure before it gives way."""
        change = _CHANGE.take(((guess == ids).view(np.int8) << 3) + level, mode="clip")
        kept = entry + change
        np.copyto(kept, ids << 3 | 1, where=change == _FRESH)
        self.entries[slot] = kept


def _pairs(guess: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The number of the pair of levels, and whether both orders predict the same."""
    return (level[1] << 3) + level[0] + (guess[0] == guess[1]) * level.dtype.type(64)


def _shares(pairs: np.ndarray, which: np.ndarray) -> np.ndarray:
    """(order 2, order 1) of the mix's total for each pair, from what came true."""
    seen = np.bincount(pairs.astype(np.int64) * 3 + which, minlength=3 * _PAIRS).reshape(_PAIRS, 3)
    number = np.arange(_PAIRS)
    two = (number >> 3) % _LEVELS > 0
    one = (number % _LEVELS > 0) & ~(two & (number >= _PAIRS // 2))
    room = (1 << _MIX_BITS) - _LEAST - 2
    shares = seen[:, :2] * room // np.maximum(seen.sum(1), 1)[:, None]
    return np.stack([np.where(two, shares[:, 0] + 1, 0), np.where(one, shares[:, 1] + 1, 0)], axis=1)


def _mix(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of what order 2, order 1 and order 0 have of the mix, three for each pair."""
    sizes = np.concatenate([shares, (1 << _MIX_BITS) - shares.sum(1)[:, None]], axis=1)
    return (np.cumsum(sizes, axis=1) - sizes).ravel(), sizes.ravel()


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """``counts``, all above 0, brought to order 0's total, none below 1."""
    total = 1 << _ZERO_BITS

    def scaled(by: int) -> np.ndarray:
        return np.maximum(1, (counts * (by / (int(counts.sum()) << 20))).astype(np.int64))

    low, high = 0, total << 20
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if scaled(middle).sum() <= total else (low, middle - 1)
    out = scaled(low)
    out[np.argmax(out)] += total - out.sum()
    return out


def _kind(ranks: int) -> type:
    """Of whole numbers that hold ranks, and entries."""
    return np.int32 if ranks < 1 << 28 else np.int64


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, from the most frequent; the rank of each id of the group)."""
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        values = values[np.argsort(-counts[values], kind="stable")]
        rank = np.zeros(len(counts), np.int64)
        rank[values] = np.arange(len(values))
        return values.astype(np.uint32), rank[ids]
    values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order].astype(np.uint32), rank[inverse]


def _low_bits(ranks: int) -> int:
    """How many low bits of a rank order 0 writes as they are."""
    return max(0, (ranks - 1).bit_length() - _SYMBOLS_BITS)


class _Writer:
    """The lanes' ranges. A carry stays in the low end until its word, and is passed on in the end."""

    def __init__(self, lanes: int, room: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, _FULL, np.int64)
        self.words = np.zeros((lanes, room), np.int32)
        self.flat = self.words.ravel()
        self.begin = np.arange(lanes) * room
        self.place = self.begin.copy()

    def narrow(self, alive: int, below: np.ndarray, share: np.ndarray, bits: int, some: np.ndarray | None = None) -> None:
        now = self.range[:alive]
        unit = now >> bits
        self.low[:alive] += unit * below
        unit *= share
        self.range[:alive] = unit if some is None else np.where(some, unit, now)

    def settle(self, alive: int) -> None:
        at = np.flatnonzero(self.range[:alive] < _BOTTOM)
        while len(at):
            low, place, size = self.low[at], self.place[at], self.range[at] << 16
            self.flat[place] = low >> 32
            self.low[at] = (low & (_BOTTOM - 1)) << 16
            self.range[at] = size
            self.place[at] = place + 1
            at = at[size < _BOTTOM]

    def finish(self) -> np.ndarray:
        """How many words each lane has."""
        for _ in range(3):
            self.flat[self.place] = self.low >> 32
            self.low = (self.low & (_BOTTOM - 1)) << 16
            self.place += 1
        used = self.place - self.begin
        self.words = self.words[:, : int(used.max())]
        while (carry := self.words >> 16).any():
            self.words &= 0xFFFF
            self.words[:, :-1] += carry[:, 1:]
        return used


def _predicted(grid: np.ndarray, alive: list[int], ranks: int) -> np.ndarray:
    """The entries of both orders before each id of ``grid`` (steps by lanes): (order, step, lane)."""
    steps, lanes = grid.shape
    follow = _Followers(lanes, ranks)
    told = np.zeros((steps + 2, lanes), np.uint32)
    np.add(grid, 1, out=told[2:], casting="unsafe")
    out = np.zeros((2, steps, lanes), grid.dtype)
    for begin in range(0, steps, _AHEAD):
        end = min(begin + _AHEAD, steps)
        slots = follow.slots(lanes, told[begin + 1 : end + 1], told[begin:end])
        for step in range(begin, end):
            slot = slots[:, step - begin, : alive[step]]
            entry = follow.entries.take(slot)
            out[:, step, : alive[step]] = entry
            follow.learn(slot, entry, entry >> 3, entry & _SURE, grid[step, : alive[step]])
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A group: a head, with a line for each block (ids, words, crc32 of the ids), and the words."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if not len(ids):
        return _HEAD.pack(MAGIC, block, 0, 0, 0, 0)
    n = -(-len(ids) // block)
    lengths = np.minimum(block, len(ids) - block * np.arange(n))
    alive = [n if step < lengths[-1] else n - 1 for step in range(int(lengths[0]))]
    values, rank = _ranks(ids)
    low_bits = _low_bits(len(values))
    grid = np.zeros(n * block, _kind(len(values)))
    grid[: len(ids)] = rank
    grid = np.ascontiguousarray(grid.reshape(n, block)[:, : len(alive)].T)
    entries = _predicted(grid, alive, len(values))
    which = np.empty(grid.shape, np.int8)
    pairs = np.empty(grid.shape, np.int16)
    for begin in range(0, len(grid), _AHEAD):
        steps = slice(begin, begin + _AHEAD)
        entry = entries[:, steps]
        guess, level = entry >> 3, entry & _SURE
        right1, right2 = (guess == grid[steps]) & (level > 0)
        which[steps] = np.where(right2, 0, np.where(right1, 1, 2))
        pairs[steps] = _pairs(guess, level)
    del entries
    valid = np.arange(len(grid))[:, None] < lengths
    shares = _shares(pairs[valid], which[valid])
    begins, sizes = _mix(shares)
    frequencies = _frequencies(np.bincount(grid[(which == 2) & valid] >> low_bits))
    before = np.cumsum(frequencies) - frequencies
    coder = _Writer(n, 3 * block + 16)
    for begin in range(0, len(grid), _AHEAD):
        steps = slice(begin, begin + _AHEAD)
        rest = which[steps] == 2
        part = pairs[steps] * np.int64(3) + which[steps]
        below, share = begins[part], sizes[part]
        symbol = grid[steps] >> low_bits
        below0, share0 = before[symbol] * rest, frequencies[symbol]
        low = (grid[steps] & ((1 << low_bits) - 1)) * rest
        for i in range(len(rest)):
            lanes = alive[begin + i]
            some = rest[i, :lanes]
            coder.narrow(lanes, below[i, :lanes], share[i, :lanes], _MIX_BITS)
            coder.narrow(lanes, below0[i, :lanes], share0[i, :lanes], _ZERO_BITS, some)
            coder.settle(lanes)
            if low_bits:
                coder.narrow(lanes, low[i, :lanes], np.int64(1), low_bits, some)
                coder.settle(lanes)
    used = coder.finish()
    raw = memoryview(ids.tobytes())
    table = [
        (int(lengths[i]), int(used[i]), zlib.crc32(raw[4 * i * block : 4 * (i * block + int(lengths[i]))]))
        for i in range(n)
    ]
    model = [shares.astype("<u2"), frequencies.astype("<u4"), values.astype("<u4"), np.array(table, "<u4")]
    model = zlib.compress(b"".join([x.tobytes() for x in model]))
    head = _HEAD.pack(MAGIC, block, n, len(values), len(model), zlib.crc32(model))
    return b"".join([head, model, *(coder.words[i, :w].astype("<u2").tobytes() for i, w in enumerate(used))])


def decode(group: bytes) -> np.ndarray:
    """The ids of a group; its head and each block are checked against their crc32."""
    if group[:4] != MAGIC:
        raise ValueError("not a group of coded ids")
    _, block, n, ranks, size, crc = _HEAD.unpack_from(group)
    model = group[_HEAD.size : _HEAD.size + size]
    if zlib.crc32(model) != crc:
        raise ValueError("the head is damaged")
    if not n:
        return np.zeros(0, np.uint32)
    model, low_bits = zlib.decompress(model), _low_bits(ranks)
    symbols = ((ranks - 1) >> low_bits) + 1
    shares = np.frombuffer(model, "<u2", 2 * _PAIRS).reshape(_PAIRS, 2).astype(np.int64)
    frequencies = np.frombuffer(model, "<u4", symbols, 4 * _PAIRS).astype(np.int64)
    values = np.frombuffer(model, "<u4", ranks, 4 * (_PAIRS + symbols))
    table = np.frombuffer(model, "<u4", 3 * n, 4 * (_PAIRS + symbols + ranks))
    lengths, sizes, sums = table.reshape(n, 3).T.astype(np.int64)
    if len(group) != _HEAD.size + size + 2 * int(sizes.sum()):
        raise ValueError("a group of coded ids is not whole")
    words = np.frombuffer(group, "<u2", -1, _HEAD.size + size).astype(np.int64)
    grid = _decoded(words, np.cumsum(sizes) - sizes, lengths, shares, frequencies, ranks)
    ids = values[np.minimum(grid, ranks - 1)].T[np.arange(len(grid)) < lengths[:, None]].astype(np.uint32)
    raw = memoryview(ids.tobytes())
    for i in range(n):
        if zlib.crc32(raw[4 * i * block : 4 * (i * block + int(lengths[i]))]) != sums[i]:
            raise ValueError(f"block {i} is damaged")
    return ids


def _decoded(
    words: np.ndarray, place: np.ndarray, lengths: np.ndarray, shares: np.ndarray, frequencies: np.ndarray, ranks: int
) -> np.ndarray:
    """The ranks, steps by lanes. A lane's ``point`` is the code less the range's low end."""
    alive = len(lengths)
    follow = _Followers(alive, ranks)
    kind = follow.entries.dtype
    begins, sizes = _mix(shares)
    end2, end1 = np.ascontiguousarray(shares[:, 0]), shares.sum(1)
    before = np.cumsum(frequencies) - frequencies
    symbol_at = np.repeat(np.arange(len(frequencies)), frequencies)
    low_bits = _low_bits(ranks)
    grid = np.zeros((int(lengths[0]), alive), kind)
    last, older = np.zeros(alive, np.uint32), np.zeros(alive, np.uint32)
    width = np.full(alive, _FULL, np.int64)
    point = words[place] << 32 | words[place + 1] << 16 | words[place + 2]
    place = place + 3

    def settle() -> None:
        at = np.flatnonzero(width < _BOTTOM)
        while len(at):
            next_word, size = place[at], width[at] << 16
            point[at] = point[at] << 16 | words.take(next_word, mode="clip")
            width[at] = size
            place[at] = next_word + 1
            at = at[size < _BOTTOM]

    for step in range(len(grid)):
        if step == lengths[-1]:
            alive -= 1
            width, point, place, last, older = (x[:alive].copy() for x in (width, point, place, last, older))
        slot = follow.slots(alive, last, older)
        entry = follow.entries.take(slot)
        guess, level = entry >> 3, entry & _SURE
        pair = _pairs(guess, level).astype(np.int64)
        unit = width >> _MIX_BITS
        value = point // unit
        not2, some = value >= end2[pair], value >= end1[pair]
        pair *= 3
        pair += not2
        pair += some
        point -= unit * begins[pair]
        width = unit * sizes[pair]
        unit = width >> _ZERO_BITS
        symbol = symbol_at[(point // unit) & ((1 << _ZERO_BITS) - 1)]
        point -= unit * before[symbol] * some
        width = np.where(some, unit * frequencies[symbol], width)
        settle()
        if low_bits:
            unit = width >> low_bits
            low = (point // unit) & ((1 << low_bits) - 1)
            point -= unit * low * some
            width = np.where(some, unit, width)
            settle()
            symbol = symbol << low_bits | low
        ids = np.where(some, symbol, np.where(not2, guess[0], guess[1])).astype(kind)
        grid[step, :alive] = ids
        follow.learn(slot, entry, guess, level, ids)
        older, last = last, ids.astype(np.uint32) + np.uint32(1)
    return grid
