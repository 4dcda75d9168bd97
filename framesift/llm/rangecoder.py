"""Token ids packed by an arithmetic coder that mixes predictions of three orders.

Blocks of ids are coded each from a fresh start and side by side, one lane a
block, so that numpy works on all of them at once. In each step a lane has
three guesses at the next id: what followed the last two ids the last time,
what followed the last one, and what has been most frequent lately. Each
guess's share follows how often it has been right; what they leave is spread
over classes of ids by number of bits, whose shares follow what has been seen.
"""

from __future__ import annotations

import numpy as np

U, I = np.uint64, np.int64
BLOCK = 512
# Shares of guesses (of 2^16) adapt by this shift and stay within these bounds, which leave classes at least 2^12 of 2^20.
SHIFT = 4
MOST = np.array([[62000], [48000], [32000]], np.int32)
# Classes are ids of up to 8 bits, of 9, … of 16; what a class leaves open are as many bits, for all but the first one less.
TOTAL, CLASSES, FEW = 20, 9, 8
WORD, LOW, FULL = U(32), U(0xFFFFFFFF), U(1 << 32)
_KINDS = np.maximum(np.floor(np.log2(np.maximum(np.arange(65536), 1))).astype(np.int8) + 1 - FEW, 0).astype(np.int8)
_OPEN = np.maximum(np.arange(CLASSES) + FEW - 1, FEW)
_PLACES = np.arange(CLASSES + 1, dtype=np.int16)[:, None]
_GUESSES = np.arange(3, dtype=np.int8)[:, None]


class Model:
    """What all lanes have learned so far. Arrays are held, as new ones of their
    size each step would cost more than the sums."""

    def __init__(self, lanes: int):
        self.lanes, self.every = lanes, np.arange(lanes)
        self.rows = self.every * BLOCK
        self.one, self.two = np.zeros(lanes * BLOCK, np.uint16), np.zeros(lanes * BLOCK, np.uint16)
        self.last = self.before = np.zeros(lanes, I)
        self.guesses, self.count = np.zeros((3, lanes), I), np.zeros(lanes, I)
        self.shares, self.steps = np.full((3, lanes), 4096, np.int32), np.empty((3, lanes), np.int32)
        self.starts, self.left = np.zeros((5, lanes), I), np.empty(lanes, I)
        self.classes = np.broadcast_to(_PLACES * (4096 // CLASSES), (CLASSES + 1, lanes)).astype(np.int16)
        self.classes[CLASSES] = 4096
        self.after, self.step = np.empty(self.classes.shape, bool), np.empty_like(self.classes)
        self.part, self.index = np.empty(lanes, I), np.empty(lanes, I)

    def guess(self) -> None:
        """The three guesses, where each one's share begins, and what is left for classes."""
        mixed = self.last * 40503
        self.at_one = (mixed >> 4 & BLOCK - 1) + self.rows
        self.at_two = (mixed + self.before * 30011 >> 3 & BLOCK - 1) + self.rows
        self.guesses[0] = self.two.take(self.at_two)
        self.guesses[1] = self.one.take(self.at_one)
        self.left.fill(1 << TOTAL)
        for k in range(3):
            np.multiply(self.left, self.shares[k], out=self.part)
            self.part >>= 16
            np.add(self.starts[k], self.part, out=self.starts[k + 1])
            self.left -= self.part

    def kinds(self, value: np.ndarray) -> np.ndarray:
        """The class whose part of what is left a value lies in: the last place
        of 4096 that starts at or before the value says so."""
        place = np.maximum(value - self.starts[3], 0)
        place += 1
        place <<= 12
        place -= 1
        place //= self.left
        np.less_equal(self.classes[1:CLASSES], place.astype(np.int16), out=self.after[1:CLASSES])
        return self.after[1:CLASSES].view(np.int8).sum(0, dtype=np.int8).astype(I)

    def interval(self, which: np.ndarray, other: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of a right guess, or of a class, begins, and its size."""
        np.multiply(which, self.lanes, out=self.index, dtype=I)
        self.index += self.every
        begin, flat = self.starts.take(self.index), self.classes.reshape(-1)
        self.index += self.lanes
        end = self.starts.take(self.index)
        np.multiply(kind, self.lanes, out=self.index, dtype=I)
        self.index += self.every
        first = flat.take(self.index) * self.left >> 12
        self.index += self.lanes
        beyond = flat.take(self.index) * self.left >> 12
        size = np.where(other, beyond - first, end - begin)
        first *= other
        first += begin
        return first.view(U), size.view(U)

    def learn(self, ids: np.ndarray, which: np.ndarray, other: np.ndarray, kind: np.ndarray) -> None:
        # Guesses after the right one aren't tried.
        np.multiply(which == _GUESSES, np.int32(1 << 16), out=self.steps)
        self.steps -= self.shares
        self.steps >>= SHIFT
        self.steps *= which >= _GUESSES
        self.shares += self.steps
        np.maximum(self.shares, 64, out=self.shares)
        np.minimum(self.shares, MOST, out=self.shares)
        # Each class's edge moves towards 0 or all, but for one place a class.
        np.greater(_PLACES, kind.astype(np.int16), out=self.after)
        np.multiply(self.after, np.int16(4096 - CLASSES), out=self.step)
        self.step += _PLACES
        self.step -= self.classes
        self.step >>= 4
        self.step *= other.astype(np.int16)
        self.classes += self.step
        narrow = ids.astype(np.uint16)
        self.two[self.at_two] = narrow
        self.one[self.at_one] = narrow
        often = self.guesses[2]
        right = ids == often
        self.count += right
        self.count += right
        self.count -= 1
        np.copyto(often, ids, where=self.count < 0)
        np.maximum(self.count, 0, out=self.count)
        self.before, self.last = self.last, ids


def unsettled(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lanes whose upper word is known, or too narrow, with their low and span."""
    same = low + span
    same ^= low
    ready = np.flatnonzero((same < FULL) | (span < FULL))
    l, s = low.take(ready), span.take(ready)
    return ready, l, np.where(same.take(ready) < FULL, s, ~l + U(1) & LOW)


def encode(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of ids (lanes by ``BLOCK``) as 32-bit words: each lane's, one
    after the other, and how many each has."""
    lanes = len(blocks)
    model, low, span = Model(lanes), np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    out, used = np.zeros((lanes, BLOCK + BLOCK // 4 + 8), np.uint32), np.zeros(lanes, I)
    flat, rows = out.reshape(-1), np.arange(lanes) * out.shape[1]

    def settle():
        ready, l, s = unsettled(low, span)
        if len(ready):
            at = used.take(ready)
            flat[rows.take(ready) + at] = (l >> WORD).astype(np.uint32)
            used[ready] = at + 1
            low[ready], span[ready] = l << WORD, s << WORD

    columns = np.ascontiguousarray(blocks.T)
    for ids, kind in zip(columns.astype(I), _KINDS.take(columns)):
        model.guess()
        wrong = ids != model.guesses
        wrong[1] &= wrong[0]
        wrong[2] &= wrong[1]
        which, other, kind = wrong.view(np.int8).sum(0, dtype=np.int8), wrong[2], kind.astype(I)
        begin, size = model.interval(which, other, kind)
        span >>= U(TOTAL)
        begin *= span
        low += begin
        span *= size
        settle()
        bits = _OPEN.take(kind) * other
        span >>= bits.view(U)
        low += (ids & (I(1) << bits) - 1).view(U) * span
        settle()
        model.learn(ids, which, other, kind)
    for shift in (WORD, U(0)):
        out[np.arange(lanes), used] = (low >> shift & LOW).astype(np.uint32)
        used += 1
    return out[np.arange(out.shape[1]) < used[:, None]], used


def decode(words: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The blocks that ``encode`` packed."""
    lanes = len(used)
    model, low, span = Model(lanes), np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    words = np.concatenate((words.astype(U), np.zeros(2, U)))
    at = np.cumsum(used) - used
    code = words[at] << WORD | words[at + 1]
    at += 2
    out = np.zeros((BLOCK, lanes), np.uint16)

    def settle():
        ready, l, s = unsettled(low, span)
        if len(ready):
            place = at.take(ready)
            code[ready] = code.take(ready) << WORD | words.take(np.minimum(place, len(words) - 1))
            at[ready] = place + 1
            low[ready], span[ready] = l << WORD, s << WORD

    for column in out:
        model.guess()
        span >>= U(TOTAL)
        value = np.minimum((code - low) // span, U((1 << TOTAL) - 1)).view(I)
        beyond = value >= model.starts[1:4]
        which, other = beyond.view(np.int8).sum(0, dtype=np.int8), beyond[2]
        kind = model.kinds(value)
        begin, size = model.interval(which, other, kind)
        begin *= span
        low += begin
        span *= size
        settle()
        bits = _OPEN.take(kind) * other
        span >>= bits.view(U)
        offset = np.minimum((code - low) // span, ((I(1) << bits) - 1).view(U))
        low += offset * span
        settle()
        guessed = model.guesses.take(np.minimum(which, 2) * I(lanes) + model.every)
        ids = np.where(other, ((kind > 0).astype(I) << bits) + offset.view(I), guessed)
        column[:] = ids
        model.learn(ids, which, other, kind)
    return np.ascontiguousarray(out.T)
