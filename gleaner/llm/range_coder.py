"""Range coder for numbers with mixed predictions of order 0 to 2.

Numbers (places of token ids in a list of the ids in use) are coded in blocks that
start anew: no block needs another to be read. Within a block three predictions
share the coding range. The last two numbers predict the one that followed them
before (order 2), so does the last number alone (order 1), and the counts so far
spread the rest (order 0). How much of the range the first two get is learned per
state of confidence: how often each was right of late, and whether both name the
same number. A number that order 0 does not know yet is escaped and written plainly.

All steps are integer arithmetic. Blocks are coded side by side, one numpy lane
each: a step handles the next number of every block at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048  #: numbers of a block
LANES = 4096  #: blocks that are coded side by side
SLOTS = 1024  #: numbers that a block learns; further ones are written plainly
PAIRS = 1 << 12  #: places for what followed two numbers
TOTAL, ORDER0 = 16, 13  #: bits of the coding range that is shared, and of order 0's counts
RATE, SURE = 5, 3  #: speed of learning, highest confidence
MOST = (1 << TOTAL) - (1 << ORDER0) - 256  #: what orders 1 and 2 may have of the range, about
STRIDE = SLOTS + 2  #: slot 0 stands for the escape, the last one for numbers without a slot
WIDTH, LOW = (1 << 48) - 1, (1 << 32) - 1
#: Two shares in one number: order 2's below, order 1's above. What a step adds to them, by
#: what was right: neither, order 2, order 1.
FIELD = np.int64(1 << 32)
DECAY = np.int64((0xFFFF >> RATE) * (1 + (1 << 32)))
GAIN = np.array([1, (MOST >> RATE) + 1, 1], np.int64) + FIELD * np.array([1, 1, (MOST >> RATE) + 1], np.int64)


class Damaged(ValueError):
    """Coded data that no encoder wrote."""


def _refresh(step: int) -> bool:
    """When order 0 takes in the counts: often at first, then every 256 numbers."""
    return step & (step - 1) == 0 if step < 256 else step % 256 == 0


class _Model:
    """Predictions of many blocks; both directions of the coder run it alike."""

    def __init__(self, lanes: int, kinds: int, longest: int):
        self.lanes, self.kinds = lanes, kinds
        n = np.arange(lanes, dtype=np.int64)
        self.at_kind, self.at_slot, self.at_state = n * kinds, n * STRIDE, n * 32
        self.at_context = np.stack([n * STRIDE, lanes * STRIDE + n * PAIRS])
        self.slot_of = np.zeros(lanes * kinds, np.uint16)
        self.kind_of = np.zeros(lanes * STRIDE, np.uint32)
        self.used = np.ones(lanes, np.int64)
        # of each slot: its start in order 0's table, its end << 16, its count << 32
        self.order0 = np.zeros((lanes, STRIDE), np.int64)
        self.slots = self.order0.reshape(-1)
        # what followed each slot, and each pair of slots: slot * 4 + confidence
        self.contexts = np.full(lanes * (STRIDE + PAIRS), (SLOTS + 1) << 2, np.uint16)
        self.shares = np.full(lanes * 32, 1024 * (1 + (1 << 32)), np.int64)
        self.index = np.zeros((2, lanes), np.int64)
        self.before, self.pair = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.place = np.zeros(0, np.uint16)

    def refresh(self, places: bool) -> None:
        """Order 0's table: every slot that was seen gets its part, the escape at least one."""
        width = int(self.used.max())
        counts = self.order0[:, :width] >> 32
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        part = counts * ((1 << ORDER0) - self.used[:, None]) // total + (counts > 0)
        part[:, 0] = 0
        part[:, 0] = (1 << ORDER0) - part.sum(1)
        ends = np.cumsum(part, 1)
        self.order0[:, :width] = (ends - part) | ends << 16 | counts << 32
        if places:
            self.place = np.repeat(np.tile(np.arange(width, dtype=np.uint16), self.lanes), part.reshape(-1))

    def predict(self, a: int) -> None:
        """Predicted slots and shares of the first ``a`` lanes."""
        index = self.index[:, :a]
        np.add(self.at_context[0, :a], self.before[:a], out=index[0])
        np.add(self.at_context[1, :a], self.pair[:a], out=index[1])
        self.e = self.contexts.take(index)
        self.c = self.e >> 2
        self.sure = self.e & 3
        state = (self.sure[1] << 2) | self.sure[0]
        state += (self.c[0] == self.c[1]).view(np.uint8) * np.uint16(16)
        self.state = self.at_state[:a] + state
        self.share = self.shares.take(self.state)
        self.w2 = self.share & LOW
        self.used_range = self.w2 + (self.share >> 32)
        self.rest = (1 << TOTAL) - self.used_range

    def spread(self, a: int, table: np.ndarray):
        """Order 0's starts and ends within what orders 1 and 2 leave of the range."""
        return (self.used_range[:a] + (self.rest[:a] * (table & 0xFFFF) >> ORDER0),
                self.used_range[:a] + (self.rest[:a] * ((table >> 16) & 0xFFFF) >> ORDER0))

    def look(self, a: int, slot: np.ndarray) -> np.ndarray:
        """What order 0 knows of slots; counts them."""
        self.at = self.at_slot[:a] + slot
        found = self.slots.take(self.at)
        self.slots[self.at] = found + (1 << 32)
        return found

    def escape(self, lanes: np.ndarray) -> np.ndarray:
        """What order 0 knows of the escape, which takes the count of the slots looked at."""
        self.slots[self.at[lanes]] -= 1 << 32
        found = self.order0[lanes, 0]
        self.order0[lanes, 0] = found + (1 << 32)
        return found

    def learn(self, a: int, slot: np.ndarray, same: np.ndarray, right: np.ndarray) -> None:
        """``same``: whether orders 1 and 2 named the slot; ``right``: which was used."""
        share = self.share - ((self.share >> RATE) & DECAY)
        self.shares[self.state] = share + GAIN.take(right)
        e, short = self.e, slot.astype(np.uint16) << 2
        self.contexts[self.index[:, :a]] = np.where(same, e + (self.sure < SURE), np.where(self.sure > 0, e - 1, short))
        self.pair[:a] = (self.before[:a] * 1217 + slot * 5) & (PAIRS - 1)
        self.before[:a] = slot

    def new(self, lanes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Slots of escaped numbers; those seen for the first time get one while there are some."""
        slot = self.slot_of.take(self.at_kind.take(lanes) + kinds).astype(np.int64)
        fresh = np.flatnonzero((slot == 0) & (self.used[lanes] <= SLOTS))
        got = lanes[fresh]
        slot[fresh] = self.used[got]
        self.slot_of[self.at_kind[got] + kinds[fresh]] = slot[fresh]
        self.kind_of[self.at_slot[got] + slot[fresh]] = kinds[fresh]
        self.used[got] += 1
        slot[slot == 0] = SLOTS + 1
        self.slots[self.at_slot[lanes] + slot] += 1 << 32
        return slot


def _plain_steps(kinds: int) -> list[tuple[int, int]]:
    """Shift and number of choices of the steps that write a number plainly."""
    return [(0, kinds)] if kinds <= 1 << TOTAL else [(TOTAL, ((kinds - 1) >> TOTAL) + 1), (0, 1 << TOTAL)]


def _lanes(kinds: int) -> int:
    """Blocks side by side whose tables of numbers stay under 128 MB."""
    return max(1, min(LANES, (1 << 26) // max(kinds, 1)))


def encode(numbers: np.ndarray, kinds: int, block: int = BLOCK) -> list[tuple[int, bytes]]:
    """``(count, coded bytes)`` of each block of ``numbers``, which are below ``kinds`` (at most 2^32)."""
    out = []
    step = _lanes(kinds) * block
    for low in range(0, len(numbers), step):
        out += _encode(numbers[low:low + step], kinds, block)
    return out


def _encode(numbers: np.ndarray, kinds: int, block: int) -> list[tuple[int, bytes]]:
    n = len(numbers)
    lanes = -(-n // block)
    size = n - block * (lanes - 1)  # of the last block
    longest = block if lanes > 1 else size
    table = np.zeros((lanes, block), np.uint32)
    table.reshape(-1)[:n] = numbers
    table = _turned(table)
    plain_steps = _plain_steps(kinds)
    rows = 1 + len(plain_steps)
    model = _Model(lanes, kinds, longest)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, WIDTH, np.int64)
    # digits of 16 bits (and a carry) of each step, and whether the step gives one
    digits, given = np.zeros((longest * rows + 3, lanes), np.int32), np.zeros((longest * rows + 3, lanes), bool)

    def narrow(width, low, start, end):
        """Give the interval its part: new width and low, the digit, and whether it goes out."""
        part = width >> TOTAL
        base = low + part * start
        part *= end - start
        small = part <= LOW
        shift = small.view(np.uint8) << 4
        return part << shift, np.where(small, base & LOW, base) << shift, base >> 32, small

    for t in range(longest):
        a = lanes if t < size else lanes - 1
        if _refresh(t):
            model.refresh(False)
        kind = table[t, :a].astype(np.int64)
        model.predict(a)
        slot = model.slot_of.take(model.at_kind[:a] + kind)
        same = model.c == slot
        hit2, hit1 = same[1], same[0] & ~same[1]
        right = hit2.view(np.uint8) + (hit1.view(np.uint8) << 1)
        slot = slot.astype(np.int64)
        found = model.look(a, slot)
        plain = np.flatnonzero((((found ^ (found >> 16)) & 0xFFFF == 0) | (slot == 0)) & (right == 0))
        found[plain] = model.escape(plain)
        start, end = model.spread(a, found)
        either = right > 0
        start = np.where(either, model.w2 * hit1, start)
        end = np.where(either, np.where(hit2, model.w2, model.used_range), end)
        row = t * rows
        width[:a], low[:a], digits[row, :a], given[row, :a] = narrow(width[:a], low[:a], start, end)
        if len(plain):
            exact = kind[plain]
            for k, (shift, choices) in enumerate(plain_steps, 1):
                x = (exact >> shift) & ((1 << TOTAL) - 1) if len(plain_steps) > 1 else exact
                width[plain], low[plain], digits[row + k, plain], given[row + k, plain] = narrow(
                    width[plain], low[plain], (x << TOTAL) // choices, ((x + 1) << TOTAL) // choices)
            slot[plain] = model.new(plain, exact)
        model.learn(a, slot, same, right)
    for k in range(3):
        digits[longest * rows + k], given[longest * rows + k] = low >> 32, True
        low = (low & LOW) << 16
    flat = _carried(_turned(digits)[_turned(given)])
    ends = np.cumsum(given.sum(0))
    sizes = [longest] * (lanes - 1) + [size]
    return [(s, flat[e - k:e].tobytes()) for s, e, k in zip(sizes, ends, given.sum(0))]


def _carried(digits: np.ndarray) -> np.ndarray:
    """Digits of 16 bits after their carries (bit 16) went to the digits before them. A
    block's first digit has none to give, so blocks stay apart."""
    over = np.flatnonzero(digits > 0xFFFF)
    while len(over):
        digits[over] -= 1 << 16
        digits[over - 1] += 1
        over = over[digits[over - 1] > 0xFFFF] - 1
    return digits.astype(">u2")


def decode(blocks: list[tuple[int, bytes]], kinds: int) -> list[np.ndarray]:
    """The numbers of each block, as unsigned 32-bit integers."""
    order = sorted(range(len(blocks)), key=lambda k: -blocks[k][0])
    out: list = [None] * len(blocks)
    step = _lanes(kinds)
    for first in range(0, len(order), step):
        part = order[first:first + step]
        for k, numbers in zip(part, _decode([blocks[k] for k in part], kinds)):
            out[k] = numbers
    return out


def _decode(blocks: list[tuple[int, bytes]], kinds: int) -> list[np.ndarray]:
    lanes = len(blocks)
    sizes = np.array([n for n, _ in blocks])
    longest = int(sizes[0])
    active = lanes - np.searchsorted(sizes[::-1], np.arange(longest), "right")
    plain_steps = _plain_steps(kinds)
    model = _Model(lanes, kinds, longest)
    # each block's digits, and zeros beyond its end
    ends = np.cumsum([len(b) // 2 + 4 for _, b in blocks])
    digits = np.zeros(int(ends[-1]), np.int64)
    at = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for k, (_, data) in enumerate(blocks):
        digits[at[k]:at[k] + len(data) // 2] = np.frombuffer(data, ">u2", len(data) // 2)
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = code << 16 | digits[at]
        at += 1
    last = ends - 1
    width = np.full(lanes, WIDTH, np.int64)
    table = np.zeros((longest, lanes), "<u4")

    def value(code, part):
        """The place in the shared range that the code points to (exact: 48 of 53 bits)."""
        return np.minimum((code / part).astype(np.int64), (1 << TOTAL) - 1)

    def narrow(code, part, at, last, start, end):
        base = code - part * start
        part = part * (end - start)
        small = part <= LOW
        shift = small.view(np.uint8) << 4
        return part << shift, base << shift | digits.take(at) * small, np.minimum(at + small, last)

    lane0 = np.arange(lanes, dtype=np.int64) << ORDER0
    for t in range(longest):
        a = int(active[t])
        if _refresh(t):
            model.refresh(True)
        model.predict(a)
        part = width[:a] >> TOTAL
        v = value(code[:a], part)
        hit2, either = v < model.w2, v < model.used_range
        hit1 = either & ~hit2
        right = hit2.view(np.uint8) + (hit1.view(np.uint8) << 1)
        inside = np.maximum((((v - model.used_range + 1) << ORDER0) - 1) / model.rest, 0).astype(np.int64)
        slot = model.place.take(lane0[:a] + inside)
        slot = np.where(either, np.where(hit2, model.c[1], model.c[0]), slot).astype(np.int64)
        start, end = model.spread(a, model.look(a, slot))
        start = np.where(either, model.w2 * hit1, start)
        end = np.where(either, np.where(hit2, model.w2, model.used_range), end)
        width[:a], code[:a], at[:a] = narrow(code[:a], part, at[:a], last[:a], start, end)
        kind = model.kind_of.take(model.at_slot[:a] + slot)
        same = model.c == slot
        plain = np.flatnonzero(slot == 0)
        if len(plain):
            exact = np.zeros(len(plain), np.int64)
            for shift, choices in plain_steps:
                part = width[plain] >> TOTAL
                v = value(code[plain], part)
                x = (v * choices + choices - 1) >> TOTAL
                width[plain], code[plain], at[plain] = narrow(
                    code[plain], part, at[plain], last[plain], (x << TOTAL) // choices, ((x + 1) << TOTAL) // choices)
                exact |= x << shift
            if exact.max() >= kinds:
                raise Damaged("a number beyond its list")
            slot[plain] = model.new(plain, exact)
            kind[plain] = exact
        table[t, :a] = kind
        model.learn(a, slot, same, right)
    table = _turned(table)
    return [table[k, :n] for k, (n, _) in enumerate(blocks)]


def _turned(table: np.ndarray) -> np.ndarray:
    """The transposed table, copied in strips that stay in the cache."""
    out = np.empty(table.shape[::-1], table.dtype)
    for low in range(0, len(table), 32):
        out[:, low:low + 32] = table[low:low + 32].T
    return out
