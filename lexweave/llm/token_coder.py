"""Context-mixing range coder for token ids, many blocks at a time.

A segment is a run of ids, cut into blocks of equal length. Its header holds what every
block starts from: order-0 frequencies, for frequent ids the order-1 frequencies of their
followers, and the mixing weights. Every block is reset to that and has its own code
words and checksum, so any block can be decoded alone and damage stays within it. The
blocks advance together, one id each per step, as lanes of numpy arrays; all arithmetic
of the coding is exact, so decoding repeats what encoding did.

A block learns as it goes. Its order-2 table gives the id that followed the last two ids
before, with a confidence. Whether that guess is right is predicted by logistic mixing of
what order 0, order 1 and order 2 say of it, with weights for each confidence that are
fitted to the whole segment. An id that was not guessed is coded by its order-1 frequency,
and one that is no listed follower by its order-0 frequency; ids outside of the prior as
two halves. What doesn't depend on a block's state is worked out for many steps at once.

Layout of a segment (little-endian): ``LWT3``, u32 ids, u32 block length, u32 blocks, u32
bytes of the prior, u32 crc32 of the prior; the prior (zlib); for each block u32 code words
and u32 crc32 of its ids (as u32); then the blocks' code words (u16) one after the other.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC, BLOCK, SLOTS = b"LWT3", 2048, 2048
#: Ids and contexts that a prior lists at most, followers of a context, and how often a context or a pair must occur.
IDS, CONTEXTS, FOLLOWERS, OFTEN, TWICE = 1 << 15, 4096, 1024, 24, 2
T0, T1 = 1 << 16, 1 << 12
_P = np.arange(1, 4096)
STRETCH = np.concatenate([[-2047], np.clip(np.round(np.log(_P / (4096 - _P)) * 256), -2047, 2047), [2047]]).astype(np.int64)
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 8, 4064).astype(np.int64)
#: What order 0 and order 1 say of a guess, in 64 steps each, makes its cell.
LEVEL = np.arange(64) * 64 - 2016
#: Change of a guess's confidence (low bits of the index) after it was wrong and after it was right.
STEP = np.array([*((c >> 1) - c for c in range(16)), *(min(c + 1, 15) - c for c in range(16))], np.int32)
LOW32 = (1 << 32) - 1
#: Elements that are worked out at once, few enough for the caches.
PART = 1 << 15


def _shares(counts: np.ndarray, sizes: np.ndarray, total: int) -> np.ndarray:
    """Widths of at least 1 in proportion to counts, which sum up to total in each run of these sizes; the first of a run takes the rest."""
    first = np.cumsum(sizes) - sizes
    every = np.add.reduceat(counts, first)
    w = 1 + counts * np.repeat(total - sizes, sizes) // np.repeat(every, sizes)
    w[first] += total - np.add.reduceat(w, first)
    return w


def _planes(a: np.ndarray) -> bytes:
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


@dataclass
class Prior:
    """Order-0 and order-1 frequencies. Symbols: indices into ids, len(ids) standing for all others.

    Row 0 of order 1 serves contexts without a row. The first entry of each row is its escape to order 0.
    """

    ids: np.ndarray  # ascending
    width0: np.ndarray  # of each symbol
    context: np.ndarray  # the symbol whose followers a row holds; of row 0, len(ids)
    size: np.ndarray  # entries of each row
    follower: np.ndarray  # symbol of each entry; of an escape, len(ids) + 1
    width1: np.ndarray
    weight: np.ndarray  # for each confidence, what order 2 says and the weights of orders 0 and 1

    @classmethod
    def learn(cls, run: np.ndarray) -> Prior:
        if int(run.max()) < 1 << 20:
            counts = np.bincount(run)
            known = np.flatnonzero(counts)
            counts = counts[known]
        else:
            known, counts = np.unique(run, return_counts=True)
        if len(known) > IDS:
            keep = np.sort(np.lexsort((known, -counts))[:IDS])
            known, counts = known[keep], counts[keep]
        n = len(known)
        counts = np.append(counts, max(1, len(run) - counts.sum()))
        order0 = _shares(np.roll(counts, 1), np.array([n + 1]), T0)
        x = symbols(run, known)
        heads = np.flatnonzero(counts[:-1] >= OFTEN)
        if len(heads) > CONTEXTS:
            heads = np.sort(heads[np.lexsort((heads, -counts[heads]))[:CONTEXTS]])
        row = np.zeros(n + 1, np.int64)
        row[heads] = np.arange(1, len(heads) + 1)
        pair = np.sort(row[x[:-1]] * (n + 1) + x[1:])
        at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        pair, often = pair[at], np.diff(np.append(at, len(pair)))
        listed = (often >= TWICE) & (pair >= n + 1) & (pair % (n + 1) < n)
        pair, often = pair[listed], often[listed]
        rank = np.lexsort((pair, -often, pair // (n + 1)))
        of = pair[rank] // (n + 1)
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = np.sort(rank[place < FOLLOWERS])
        pair, often = pair[keep], often[keep]
        of = pair // (n + 1)
        size = 1 + np.bincount(of, minlength=len(heads) + 1)
        rest = np.append(1, counts[heads]) - np.bincount(of, often, len(heads) + 1).astype(np.int64)
        first = np.cumsum(size) - size
        entry = np.ones(int(size.sum()), bool)
        entry[first] = False
        follower, weight = np.full(len(entry), n + 1), np.empty(len(entry), np.int64)
        follower[entry], weight[entry] = pair % (n + 1), often
        weight[first] = np.maximum(rest, 1)
        return cls(known, np.roll(order0, -1), np.append(n, heads), size, follower, _shares(weight, size, T1), np.zeros((16, 3), np.int64))

    def dump(self) -> bytes:
        gap = lambda a: np.diff(a, prepend=0)
        step = gap(self.follower)
        step[np.cumsum(self.size) - self.size] = 0  # followers ascend within a row
        first = np.cumsum(self.size) - self.size
        step[first[self.size > 1] + 1] = self.follower[first[self.size > 1] + 1]
        parts = [gap(self.ids), self.width0, gap(self.context[1:]), self.size, step, self.width1, self.weight.ravel() & LOW32]
        return zlib.compress(struct.pack("<II", len(self.ids), len(self.size)) + b"".join(map(_planes, parts)), 6)

    @classmethod
    def load(cls, raw: bytes) -> Prior:
        raw = zlib.decompress(raw)
        n, rows = struct.unpack_from("<II", raw)
        at = 8

        def take(count: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(raw, np.uint8, 4 * count, at).reshape(4, count).T.copy().view("<u4").ravel().astype(np.int64)
            at += 4 * count
            return a

        ids, width0, context, size = np.cumsum(take(n)), take(n + 1), np.cumsum(take(rows - 1)), take(rows)
        step, width1, weight = take(int(size.sum())), take(int(size.sum())), take(48)
        first = np.cumsum(size) - size
        total = np.cumsum(step)
        follower = total - np.repeat(total[first], size)
        follower[first] = n + 1
        return cls(ids, width0, np.append(n, context), size, follower, width1, weight.astype(np.int32).astype(np.int64).reshape(16, 3))

    def ready(self) -> Prior:
        """Adds the lookup tables that both directions need."""
        n = len(self.ids)
        self.start0, self.start1 = np.cumsum(self.width0) - self.width0, np.cumsum(self.width1) - self.width1
        self.first = np.cumsum(self.size) - self.size
        self.start1 %= T1
        self.row = np.zeros(n + 2, np.int64)
        self.row[self.context[1:]] = np.arange(1, len(self.size))
        of = np.repeat(self.context, self.size)
        of[self.first] = n + 2  # an escape is no guess
        share = np.append(self.width0 >> 4, 0)[self.follower]
        say0, say1 = STRETCH[np.minimum(share, 4095)], STRETCH[self.width1]
        self.guess_of = (of << 12 | say0 + 2048 >> 6 << 6 | say1 + 2048 >> 6).astype(np.int32)  # context and cell
        self.entry = self.follower << 26 | self.start1 << 13 | self.width1
        return self

    def fit(self, cell: np.ndarray, hit: np.ndarray) -> None:
        """Set the weights from how guesses of each cell and confidence (cell * 16 + confidence) went, by Newton's steps."""
        n, k = (np.bincount(c, minlength=1 << 16).reshape(1 << 12, 16) for c in (cell, cell[hit]))
        say = np.stack([np.ones(1 << 12), np.repeat(LEVEL, 64) / 256, np.tile(LEVEL, 64) / 256])
        square = (say[:, None] * say).reshape(9, -1)
        w = np.zeros((16, 3))
        w[:, 0] = np.log((k.sum(0) + 0.5) / ((n - k).sum(0) + 0.5))
        center = w.copy()
        for _ in range(5):
            p = 1 / (1 + np.exp(-np.clip(np.einsum("cf,fx->xc", w, say), -8, 8)))
            slope = np.einsum("fx,xc->cf", say, k - n * p) - 4 * (w - center)
            bend = np.einsum("fx,xc->cf", square, n * p * (1 - p)).reshape(16, 3, 3) + 4 * np.eye(3)
            w = np.clip(w + np.clip(np.linalg.solve(bend, slope[..., None])[..., 0], -2, 2), -8, 8)
        self.weight = np.round(w * [256, 1 << 12, 1 << 12]).astype(np.int64)

    def chances(self) -> np.ndarray:
        """The chance, out of T1, that a guess is right, by cell * 16 + confidence."""
        say0, say1 = np.repeat(LEVEL, 64)[:, None], np.tile(LEVEL, 64)[:, None]
        dot = self.weight[:, 0] + (self.weight[:, 1] * say0 + self.weight[:, 2] * say1 >> 12)
        return SQUASH[np.clip(dot, -2047, 2047) + 2047].ravel().astype(np.int32)


def symbols(run: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Indices into known, len(known) for ids that are not there."""
    if not len(known):
        return np.zeros(len(run), np.int64)
    if int(known[-1]) < 1 << 20:
        table = np.full(1 << 20, len(known))
        table[known] = np.arange(len(known))
        return table[run] if int(run.max()) < 1 << 20 else np.where(run < 1 << 20, table[np.minimum(run, (1 << 20) - 1)], len(known))
    at = np.minimum(np.searchsorted(known, run), len(known) - 1)
    return np.where(known[at] == run, at, len(known))


def _slot(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where in a block's order-2 table the guess for two ids is."""
    return last * 0x9E35 + before * 0x6C8D >> 4 & SLOTS - 1


def _learnt(held: np.ndarray, entry: np.ndarray, sure: np.ndarray, valid: np.ndarray, hit: np.ndarray, came: np.ndarray) -> np.ndarray:
    """What a slot holds after the entry that came: a right guess gains confidence, a wrong one loses half of it or its place."""
    stay = sure > 1
    stay &= valid
    stay |= hit
    return np.where(stay, held + STEP.take(sure + (hit << np.int32(4)), mode="clip"), (came << 4) + 1)


class Encoder:
    """Range coders side by side: 48 bits of low, carries kept as bit 16 of the words until the end."""

    def __init__(self, n: int, steps: int):
        self.low, self.range = np.zeros(n, np.int64), np.full(n, 1 << 48, np.int64)
        self.wide = steps // 2 + 64
        self.out, self.at, self.size = np.zeros(n * self.wide, np.uint32), np.arange(n) * self.wide, np.zeros(n, np.int64)

    def put(self, start: np.ndarray, width: np.ndarray, bits: int) -> None:
        part = self.range >> bits
        self.low += part * start
        np.multiply(part, width, out=self.range)
        self.shift((self.range <= LOW32).nonzero()[0])

    def put_some(self, lanes: np.ndarray, start: np.ndarray, width: np.ndarray, bits: int) -> None:
        part = self.range[lanes] >> bits
        self.low[lanes] += part * start
        part *= width
        self.range[lanes] = part
        self.shift(lanes[part <= LOW32])

    def shift(self, lanes: np.ndarray) -> None:
        if len(lanes):
            low, size = self.low.take(lanes), self.size.take(lanes)
            if int(size.max()) >= self.wide:
                self.out = np.concatenate([self.out.reshape(-1, self.wide)] * 2, 1).ravel()
                self.at, self.wide = self.at * 2, self.wide * 2
            self.out[self.at.take(lanes) + size] = low >> 32
            self.low[lanes] = (low & LOW32) << 16
            self.range[lanes] <<= 16
            self.size[lanes] = size + 1

    def finish(self) -> list[bytes]:
        for _ in range(3):
            self.shift(np.arange(len(self.low)))
        words = self.out.reshape(-1, self.wide)[:, : int(self.size.max())].T.copy()
        for k in range(len(words) - 1, 0, -1):
            words[k - 1] += words[k] >> 16
        words = words.T.astype("<u2")
        return [words[i, :s].tobytes() for i, s in enumerate(self.size.tolist())]


class Decoder:
    def __init__(self, streams: list[np.ndarray]):
        n = len(streams)
        self.words = np.concatenate([*streams, np.zeros(4, "<u2")]).astype(np.int64)
        self.at = np.cumsum([0, *(len(s) for s in streams)])[:-1]
        self.range, self.code = np.full(n, 1 << 48, np.int64), np.zeros(n, np.int64)
        for _ in range(3):
            self.code = self.code << 16 | self.words.take(self.at, mode="clip")
            self.at = self.at + 1

    def value(self, bits: int) -> np.ndarray:
        self.part = self.range >> bits
        # exact: quotients of less than 2**24 by divisors of at most 2**32 stay clear of the next whole number
        return np.minimum((self.code / self.part).astype(np.int64), (1 << bits) - 1)

    def take(self, start: np.ndarray, width: np.ndarray) -> None:
        self.code -= self.part * start
        np.multiply(self.part, width, out=self.range)
        self.shift((self.range <= LOW32).nonzero()[0])

    def value_some(self, lanes: np.ndarray, bits: int) -> np.ndarray:
        self.part, self.some = self.range.take(lanes) >> bits, self.code.take(lanes)
        return np.minimum((self.some / self.part).astype(np.int64), (1 << bits) - 1)

    def take_some(self, lanes: np.ndarray, start: np.ndarray, width: np.ndarray | int) -> None:
        self.code[lanes] = self.some - self.part * start
        self.part *= width
        self.range[lanes] = self.part
        self.shift(lanes[self.part <= LOW32])

    def shift(self, lanes: np.ndarray) -> None:
        if len(lanes):
            at = self.at.take(lanes)
            # less than the range, unless the block is damaged
            self.code[lanes] = (np.minimum(self.code.take(lanes), LOW32) << 16) + self.words.take(at, mode="clip")
            self.range[lanes] <<= 16
            self.at[lanes] = at + 1


def _grid(n: int, block: int) -> tuple[int, int]:
    lanes = max(1, -(-n // block))
    return -(-n // lanes), lanes


def _entries(x: np.ndarray, last: np.ndarray, prior: Prior) -> np.ndarray:
    """The entry of each symbol in the row of the one before, or that row's escape."""
    other, out = len(prior.ids), np.empty(x.shape, np.int32)
    real = np.ones(len(prior.follower), bool)
    real[prior.first] = False
    keys, places = (np.repeat(np.arange(len(prior.size)), prior.size) * (other + 2) + prior.follower)[real], np.flatnonzero(real)
    width = len(prior.size) * (other + 2)
    lookup = None
    if width <= 1 << 25:
        lookup = np.zeros(width, np.int32)
        lookup[keys] = places
    else:
        keys, places = np.append(keys, np.iinfo(np.int64).max), np.append(places, 0)
    n = max(1, PART // x.shape[1])
    for t in range(0, len(x), n):
        row = prior.row.take(last[t : t + n])
        key = row * (other + 2) + x[t : t + n]
        if lookup is not None:
            e = lookup.take(key)
        else:
            at = np.searchsorted(keys, key)
            e = np.where(keys[at] == key, places[at], 0)
        out[t : t + n] = np.where(e == 0, prior.first.take(row), e)
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment holding these ids (each of 32 bits, unsigned)."""
    n = len(ids)
    if n and (int(ids.max()) >= 1 << 32 or int(ids.min()) < 0):
        raise ValueError("ids must be unsigned and of 32 bits")
    if not n:
        return MAGIC + struct.pack("<IIIII", 0, 0, 0, 0, zlib.crc32(b""))
    steps, lanes = _grid(n, block)
    padded = np.full(lanes * steps, ids[0], np.int64)
    padded[:n] = ids
    prior = Prior.learn(padded).ready()
    other = len(prior.ids)
    x = np.full((steps + 2, lanes), other, np.int32)  # led by what stands before a block
    x[2:] = symbols(padded, prior.ids).reshape(lanes, steps).T
    before, last, x = x[:-2], x[1:-1], x[2:]
    entries = _entries(x, last, prior)
    # the order-2 guesses, step by step
    held, table, base = np.empty((steps, lanes), np.int32), np.zeros(lanes * SLOTS, np.int32), np.arange(lanes) * SLOTS
    context = prior.guess_of >> 12
    for t in range(steps):
        at = base + _slot(last[t], before[t])
        h = table.take(at, out=held[t], mode="clip")
        entry = h >> 4
        valid = context.take(entry, mode="clip") == last[t]
        hit = entry == entries[t]
        hit &= valid
        table[at] = _learnt(h, entry, h & 15, valid, hit, entries[t])
    # the mixing weights, and with them the intervals of all ids
    flat_held, flat_came, flat_last = held.reshape(-1), entries.reshape(-1), last.reshape(-1)
    start, width, cell = np.empty(steps * lanes, np.int32), np.empty(steps * lanes, np.int32), np.empty(steps * lanes, np.int32)
    hits, valids = np.empty(steps * lanes, bool), np.empty(steps * lanes, bool)
    parts = [slice(k, k + PART) for k in range(0, steps * lanes, PART)]
    for k in parts:
        entry = flat_held[k] >> 4
        of = prior.guess_of.take(entry)
        valids[k] = of >> 12 == flat_last[k]
        cell[k] = ((of & 4095) << 4) + (flat_held[k] & 15)
        hits[k] = (entry == flat_came[k]) & valids[k]
    prior.fit(cell[valids], hits[valids])
    chance = prior.chances()
    escape = np.zeros(steps * lanes, bool)
    for k in parts:
        p, came = chance.take(cell[k]) * valids[k], prior.entry.take(flat_came[k])
        left = T1 - p
        start[k] = np.where(hits[k], 0, p * T1 + left * (came >> 13 & T1 - 1))
        width[k] = np.where(hits[k], p * T1, left * (came & 2 * T1 - 1))
        escape[k] = came >> 26 == other + 1
    start, width = start.reshape(steps, lanes), width.reshape(steps, lanes)
    where = np.flatnonzero(escape)
    cuts = np.searchsorted(where, np.arange(steps + 1) * lanes).tolist()
    rest, symbol = where % lanes, x.reshape(-1)[where]
    start0, width0, unlisted = prior.start0.take(symbol), prior.width0.take(symbol), symbol == other
    any_raw = np.logical_or.reduceat(np.append(unlisted, False), cuts[:-1]).tolist()
    wide, coder = padded.reshape(lanes, steps), Encoder(lanes, steps)
    for t in range(steps):
        coder.put(start[t], width[t], 24)
        if cuts[t] < cuts[t + 1]:
            k = slice(cuts[t], cuts[t + 1])
            coder.put_some(rest[k], start0[k], width0[k], 16)
            if any_raw[t]:
                raw = rest[k][unlisted[k]]
                for half in (wide[raw, t] >> 16, wide[raw, t] & 0xFFFF):
                    coder.put_some(raw, half, np.ones(len(raw), np.int64), 16)
    codes, plain, head = coder.finish(), ids.astype("<u4").tobytes(), prior.dump()
    sums = b"".join(struct.pack("<II", len(c) // 2, zlib.crc32(plain[4 * k * steps : 4 * (k + 1) * steps])) for k, c in enumerate(codes))
    return MAGIC + struct.pack("<IIIII", n, steps, lanes, len(head), zlib.crc32(head)) + head + sums + b"".join(codes)


def decode(segment: bytes, damaged: list[int] | None = None) -> np.ndarray:
    """The ids of a segment. A block whose checksum does not hold is added to damaged; without that list it is a ValueError."""
    if segment[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, steps, lanes, size, crc = struct.unpack_from("<IIIII", segment, 4)
    raw_prior = segment[24 : 24 + size]
    if zlib.crc32(raw_prior) != crc:
        raise ValueError("checksum of the prior does not hold")
    if not n:
        return np.zeros(0, np.int64)
    prior = Prior.load(raw_prior).ready()
    other = len(prior.ids)
    head = np.frombuffer(segment, "<u4", 2 * lanes, 24 + size).reshape(lanes, 2)
    words = np.frombuffer(segment, "<u2", -1, 24 + size + 8 * lanes)
    coder = Decoder(np.split(words, np.cumsum(head[:, 0].astype(np.int64))[:-1]))
    slot0 = np.repeat(np.arange(other + 1, dtype=np.int32), prior.width0)
    local = np.arange(len(prior.follower)) - np.repeat(prior.first, prior.size)
    slot1 = np.repeat(local.astype(np.uint16), prior.width1)
    known, chance = np.append(prior.ids, 0), prior.chances()
    first, row = prior.first.take(prior.row), prior.row * T1
    grid = np.zeros((steps, lanes), np.int64)
    table, base = np.zeros(lanes * SLOTS, np.int32), np.arange(lanes) * SLOTS
    last = before = np.full(lanes, other, np.int32)
    for t in range(steps):
        at = base + _slot(last, before)
        held = table.take(at, mode="clip")
        entry, sure = held >> 4, held & 15
        of = prior.guess_of.take(entry, mode="clip")
        valid = of >> 12 == last
        p = chance.take(((of & 4095) << 4) + sure, mode="clip")
        p *= valid
        flag, left = p << 12, T1 - p
        v = coder.value(24)
        hit = v < flag
        v -= flag
        np.maximum(v, 0, out=v)
        v = (v / left).astype(np.int64)
        v += row.take(last)
        e = np.where(hit, entry, first.take(last) + slot1.take(v, mode="clip"))
        came = prior.entry.take(e, mode="clip")
        coder.take(np.where(hit, 0, flag + left * (came >> 13 & T1 - 1)), np.where(hit, flag, left * (came & 2 * T1 - 1)))
        x = (came >> 26).astype(np.int32)
        rest = (x > other).nonzero()[0]
        raw = ()
        if len(rest):
            s = slot0.take(coder.value_some(rest, 16))
            coder.take_some(rest, prior.start0.take(s), prior.width0.take(s))
            x[rest] = s
            raw = rest[s == other]
        known.take(x, out=grid[t], mode="clip")
        if len(raw):
            for _ in range(2):
                half = coder.value_some(raw, 16)
                coder.take_some(raw, half, 1)
                grid[t, raw] = (grid[t, raw] << 16) + half
        table[at] = _learnt(held, entry, sure, valid, hit, e.astype(np.int32))
        before, last = last, x
    ids = grid.T.reshape(-1)[:n]
    plain = ids.astype("<u4").tobytes()
    for k, want in enumerate(head[:, 1].tolist()):
        if zlib.crc32(plain[4 * k * steps : 4 * (k + 1) * steps]) != want:
            if damaged is None:
                raise ValueError(f"checksum of block {k} does not hold")
            damaged.append(k)
    return ids
