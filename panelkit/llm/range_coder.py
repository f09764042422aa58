"""An adaptive context-mixing range coder for token ids, vectorised over lanes.

A block is coded by itself. Its ids form a matrix of lanes, each a run of the block, and
all lanes take a step together, so one numpy call codes a row of ids. The model is what
the lanes have had in earlier rounds of the block: followers of the last two ids, of the
last id, all ids, and every id of the vocabulary once. A round ends at fixed shares of the
steps; then both sides count anew, so the coder adapts and needs no table in the file.

The four predictions are mixed by weights that adapt by confidence class (how often the
two contexts were seen). An id is coded inside the part of the mixture where its share,
weight times predicted probability, is largest: first the part, then the id in it. Inside a
part, slots are the followers in sorted order, so a slot leads to its id by one lookup.

A lane's range stays between 2^32 and 2^48, so every product and quotient of the coder is a
whole number that a double holds exactly, and rows are computed in doubles. The encoder
keeps what each step adds to a lane's code and where; sums and carries are settled at the end.
"""

import zlib
from dataclasses import dataclass

import numpy as np

LANES = 2048
# The model counts at most about so many ids of a block.
HISTORY = 1 << 19
ROUNDS = (1 / 16, 1 / 4, 5 / 8)
# Steps that the encoder looks up at once.
PIECE = 64
CONTEXTS = 1 << 16
FOUND_BITS = 19
PART_BITS = 12
ID_BITS, SIZE_BITS = 17, 20
ID_LIMIT = 1 << ID_BITS
TOP, BOTTOM, WORD = 2.0 ** 48, 2.0 ** 32, 2.0 ** 16
# Words of 16 bits in a range.
RANGE_WORDS = 3
GROWTH = np.array([1.0, WORD, WORD * WORD])


def pair_slot(two_back: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A pair's context number; pairs that fall together share their followers."""
    mixed = two_back * np.uint32(0x9E3779B1) + last * np.uint32(0x85EBCA6B)
    return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(CONTEXTS - 1)


def found_slot(key: np.ndarray) -> np.ndarray:
    if key.dtype == np.uint32:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - FOUND_BITS)
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FOUND_BITS)


class Followers:
    """Ids that followed each context of one order, in runs sorted by context and id.

    ``runs`` has of each run its id, the slots of its context before it, and its own.
    """

    def __init__(self, context: np.ndarray, ids: np.ndarray, contexts: int, bits: int):
        self.bits = np.uint64(bits)
        key = self.key(context, ids)
        key.sort()
        n = len(key)
        fresh = np.ones(n, bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        heads = np.flatnonzero(fresh)
        self.keys = key[heads]
        self.sizes = np.diff(heads, append=n)
        self.count = np.bincount(context, minlength=contexts)
        self.start = np.cumsum(self.count) - self.count
        self.context = (self.keys >> self.keys.dtype.type(bits)).astype(np.intp)
        mask = self.keys.dtype.type((1 << bits) - 1)
        self.runs = packed(self.keys & mask, heads - self.start.take(self.context), self.sizes)

    def key(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Context and id in one number, of 32 bits if that is enough."""
        kind = np.uint32 if self.bits <= 16 else np.uint64
        return (context.astype(kind) << kind(self.bits)) | ids.astype(kind)

    def index(self):
        # Two keys in one slot: the later stays, the other is coded by a lower order.
        self.found = np.zeros(1 << FOUND_BITS, np.int32)
        self.found[found_slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        self.chance = self.sizes / self.count.take(self.context)

    def look(self, context: np.ndarray, ids: np.ndarray):
        """Which ids are found after their context, and the places of their runs."""
        if not len(self.keys):
            none = np.zeros(0, np.intp)
            return none, none
        key = self.key(context, ids)
        # Nothing found is the first run, whose key differs or is the right one.
        run = self.found.take(found_slot(key))
        at = np.flatnonzero(self.keys.take(run) == key)
        return at, run.take(at)


class Alone:
    """All ids without a context, as one run of slots for each that came."""

    def __init__(self, ids: np.ndarray, vocabulary: int):
        self.each = np.bincount(ids, minlength=vocabulary)
        self.before = np.cumsum(self.each) - self.each
        came = np.flatnonzero(self.each)
        self.sizes = self.each.take(came)
        self.count, self.start = np.array([len(ids)]), np.zeros(1, np.int64)
        self.runs = packed(came, self.before.take(came), self.sizes)


def packed(ids: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (before << (ID_BITS + SIZE_BITS)) | (sizes << ID_BITS) | ids.astype(np.int64)


def unpacked(runs: np.ndarray):
    """Id, slots before it and slots of each run."""
    return (runs & (ID_LIMIT - 1), runs >> (ID_BITS + SIZE_BITS),
            (runs >> ID_BITS) & ((1 << SIZE_BITS) - 1))


LEVELS = np.searchsorted(
    np.array([1, 2, 4, 8, 16, 64, 256]), np.arange(257), side="right").astype(np.int32)


def confidence(count: np.ndarray) -> np.ndarray:
    """0 to 7: how often a context was seen."""
    return LEVELS[np.minimum(count, 256)]


class Model:
    """What both sides know at the start of a round."""

    def __init__(self, ids, last, two_back, vocabulary: int, chosen: np.ndarray):
        bits = vocabulary.bit_length()
        self.vocabulary = vocabulary
        self.orders = [
            Followers(pair_slot(two_back, last), ids, CONTEXTS, bits),
            Followers(last, ids, vocabulary + 1, bits),
            Alone(ids, vocabulary)]
        self.pair_class = confidence(self.orders[0].count) * np.int32(8)
        self.last_class = confidence(self.orders[1].count)
        weights = chosen + 0.1
        share = np.floor(
            weights / weights.sum(1, keepdims=True) * ((1 << PART_BITS) - 8)).astype(np.int64) + 1
        share[:, 3] += (1 << PART_BITS) - share.sum(1)
        self.share = share
        self.weight = share.ravel().astype(np.float64)
        self.below = (np.cumsum(share, axis=1) - share).ravel().astype(np.float64)

    def to_encode(self):
        for order in self.orders[:2]:
            order.index()
        return self

    def to_decode(self):
        """One index over the contexts of all four parts, and one over their slots."""
        n = [int(o.sizes.sum()) for o in self.orders]
        self.first = np.cumsum([0, *(len(o.count) for o in self.orders)])
        begins = np.cumsum([0, *n])
        self.contexts = np.concatenate(
            [*(((o.start + k) << SIZE_BITS) | o.count
               for o, k in zip(self.orders, begins, strict=False)),
             np.array([(begins[3] << SIZE_BITS) | self.vocabulary])])
        every = np.arange(self.vocabulary, dtype=np.int64)
        self.slots = np.concatenate(
            [*(np.repeat(o.runs, o.sizes) for o in self.orders),
             (every << (ID_BITS + SIZE_BITS)) | (1 << ID_BITS) | every])
        # Cell of each 12-bit place in each class.
        self.cells = np.repeat(np.arange(256, dtype=np.uint8), self.share.ravel())
        self.pair_class = self.pair_class << PART_BITS
        self.last_class = self.last_class << PART_BITS
        return self

    def places(self, ids, pair, last):
        """Of each id its class and part as one cell, slots before it, its slots, all slots.

        Starts from the part that has every id once, and takes each order that does better.
        """
        pair, last, ids = (x.astype(np.intp) for x in (pair, last, ids))
        kind = (self.pair_class.take(pair) + self.last_class.take(last)).astype(np.intp)
        many = int(self.orders[2].count[0])
        share = self.share.T / np.array([[1], [1], [max(many, 1)], [self.vocabulary]])
        size = self.orders[2].each.take(ids)
        best, value = share[3].take(kind), share[2].take(kind) * size
        alone = value > best
        best = np.maximum(best, value)
        cell = kind * 4 + 3 - alone
        head = np.where(alone, self.orders[2].before.take(ids), ids).astype(np.float64)
        size = np.where(alone, size, 1).astype(np.float64)
        total = np.where(alone, float(many), float(self.vocabulary))
        for k, context in ((1, last), (0, pair)):
            order = self.orders[k]
            at, run = order.look(context, ids)
            kinds = kind.take(at)
            value = share[k].take(kinds) * order.chance.take(run)
            better = np.flatnonzero(value > best.take(at))
            at, run = at.take(better), order.runs.take(run.take(better))
            _, head[at], size[at] = unpacked(run)
            best[at], total[at] = value.take(better), order.count.take(context.take(at))
            cell[at] = kinds.take(better) * 4 + k
        return cell, head, size, total


@dataclass
class Plan:
    lanes: int
    steps: int
    sizes: np.ndarray
    edges: list[int]

    def active(self) -> list[int]:
        """How many lanes have an id at each step."""
        return (len(self.sizes) - np.searchsorted(
            np.sort(self.sizes), np.arange(self.steps), side="right")).tolist()


def plan_lanes(n: int) -> Plan:
    """Lanes of equal runs; only the last that has ids may be shorter, later ones are empty."""
    lanes = min(LANES, max(1, n // 256))
    steps = max(1, -(-n // lanes))
    sizes = np.clip(n - np.arange(lanes) * steps, 0, steps)
    edges = sorted({0, *(int(steps * r) for r in ROUNDS), steps})
    return Plan(lanes, steps, sizes, edges)


def contexts(matrix: np.ndarray, vocabulary: int):
    """The last id and the one before, for each place; ``vocabulary`` stands for none."""
    last = np.full_like(matrix, vocabulary)
    last[1:] = matrix[:-1]
    two_back = np.full_like(matrix, vocabulary)
    two_back[2:] = matrix[:-2]
    return last, two_back


def history(matrix, vocabulary: int, plan: Plan, upto: int):
    """Ids and contexts of the steps before ``upto``, as far as the model counts."""
    upto = min(upto, max(1, HISTORY // plan.lanes))
    lanes = int((plan.sizes >= upto).sum()) if upto else 0
    ids = matrix[:upto, :lanes]
    return tuple(x.ravel() for x in (ids, *contexts(ids, vocabulary)))


def settled(added: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each lane, and all words: every step's sum at its place, with carries.

    ``added`` is what a step adds to a lane's code, ``moved`` the words it moves on after.
    """
    used = moved.sum(0, dtype=np.int64) + RANGE_WORDS
    at = np.cumsum(used) - used
    words = np.zeros(int(used.sum()), np.int64)
    for t in range(0, len(added), PIECE):
        shift = moved[t:t + PIECE]
        ends = np.cumsum(shift, axis=0, dtype=np.int64) + at
        np.add.at(words, (ends - shift).ravel() + (RANGE_WORDS - 1), added[t:t + PIECE].ravel())
        at = ends[-1]
    # What falls on one place, and a whole code, is below the range, so no carry leaves a lane.
    while (carry := words >> 16).any():
        words &= 0xFFFF
        words[:-1] += carry[1:]
    return used, words


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block's ids as bytes: number of words of each lane, then all words.

    A packed run has 17 bits for an id.
    """
    if vocabulary > ID_LIMIT:
        raise ValueError(f"the coder takes vocabularies of up to {ID_LIMIT} ids, not {vocabulary}")
    plan = plan_lanes(len(ids))
    if not len(ids):
        return b""
    padded = np.zeros(plan.lanes * plan.steps, np.uint32)
    padded[:len(ids)] = ids
    matrix = np.ascontiguousarray(padded.reshape(plan.lanes, plan.steps).T)
    last, two_back = contexts(matrix, vocabulary)
    pair = pair_slot(two_back, last)
    del two_back
    added = np.zeros((plan.steps, plan.lanes), np.int64)
    moved = np.zeros((plan.steps, plan.lanes), np.uint8)
    state = np.full(plan.lanes, TOP)
    chosen, active = np.zeros((64, 4)), plan.active()
    for begin, end in zip(plan.edges, plan.edges[1:], strict=False):
        model = Model(*history(matrix, vocabulary, plan, begin), vocabulary, chosen).to_encode()
        for left in range(begin, end, PIECE):
            right = min(left + PIECE, end)
            cells, *columns = model.places(*(x[left:right].ravel() for x in (matrix, pair, last)))
            rows = [x.reshape(right - left, plan.lanes) for x in (
                model.below.take(cells), model.weight.take(cells), *columns)]
            for t in range(left, right):
                m = active[t]
                below, weight, head, size, total = (x[t - left, :m] for x in rows)
                wide = state[:m]
                unit = np.floor(wide * 0.5 ** PART_BITS)
                inner = np.floor(weight * unit / total)
                added[t, :m] = below * unit + head * inner
                np.multiply(size, inner, out=wide)
                # A range is 1 or more, so two words bring it above the bottom.
                short = np.add(
                    wide < BOTTOM, wide < BOTTOM / WORD, out=moved[t, :m], dtype=np.uint8)
                wide *= GROWTH.take(short)
            real = (np.arange(left, right)[:, None] < plan.sizes[None, :]).ravel()
            chosen += np.bincount(cells[real], minlength=256).reshape(64, 4)
    used, words = settled(added, moved)
    return used.astype("<u4").tobytes() + words.astype("<u2").tobytes()


def decode(data: bytes, n: int, vocabulary: int) -> np.ndarray:
    """The ids of a block of ``n`` ids."""
    plan = plan_lanes(n)
    if not n:
        return np.zeros(0, np.int64)
    lanes, steps = plan.lanes, plan.steps
    used = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    words = np.concatenate([
        np.frombuffer(data, "<u2", offset=4 * lanes).astype(np.float64), np.zeros(8)])
    ats = np.cumsum(used) - used
    # Where a lane's code lies in its range.
    codes = np.zeros(lanes)
    for _ in range(RANGE_WORDS):
        codes = codes * WORD + words[ats]
        ats += 1
    state = np.full(lanes, TOP)
    matrix = np.zeros((steps, lanes), np.uint32)
    none = np.full(lanes, vocabulary, np.uint32)
    chosen, active = np.zeros((64, 4)), plan.active()
    every, top = np.arange(lanes), 2.0 ** PART_BITS - 1
    part_row = np.tile(np.arange(4) * lanes, 64)
    for begin, end in zip(plan.edges, plan.edges[1:], strict=False):
        model = Model(*history(matrix, vocabulary, plan, begin), vocabulary, chosen).to_decode()
        places = np.repeat(model.first, lanes)
        picked = np.zeros(256, np.int64)
        for t in range(begin, end):
            m = active[t]
            last = (matrix[t - 1] if t else none)[:m]
            pair = pair_slot((matrix[t - 2] if t > 1 else none)[:m], last)
            code, wide, at = codes[:m], state[:m], ats[:m]
            unit = np.floor(wide * 0.5 ** PART_BITS)
            spot = np.minimum(code / unit, top).astype(np.int32)
            spot += model.pair_class.take(pair)
            spot += model.last_class.take(last)
            cell = model.cells.take(spot)
            code -= model.below.take(cell) * unit
            places[:m] = pair
            np.add(last, model.first[1], out=places[lanes:lanes + m], casting="unsafe")
            context = model.contexts.take(places.take(part_row.take(cell) + every[:m]))
            total = (context & ((1 << SIZE_BITS) - 1)).astype(np.float64)
            inner = np.floor(model.weight.take(cell) * unit / total)
            slot = np.minimum(code / inner, total - 1).astype(np.int64)
            slot += context >> SIZE_BITS
            ids, before, size = unpacked(model.slots.take(slot))
            matrix[t, :m] = ids
            code -= before * inner
            np.multiply(size, inner, out=wide)
            small = wide < BOTTOM
            grow = np.where(small, WORD, 1.0)
            code *= grow
            code += words.take(at) * small
            at += small
            wide *= grow
            need = np.flatnonzero(wide < BOTTOM)
            while len(need):
                code[need] = code[need] * WORD + words[at[need]]
                at[need] += 1
                wide[need] *= WORD
                need = need[wide[need] < BOTTOM]
            picked += np.bincount(cell, minlength=256)
        chosen += picked.reshape(64, 4)
    return matrix.T.ravel()[:n].astype(np.int64)


def checksum(data: bytes) -> int:
    return zlib.crc32(data)
