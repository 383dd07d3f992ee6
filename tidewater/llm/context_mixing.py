"""LM scoring: online logistic context mixing over bits.

A text is coded as its bytes and one end symbol (byte 255, which UTF-8 never holds). A byte is the bits of its path in a
Huffman tree: each of the ``TREES`` most frequent pairs of bytes before has one, and each single byte for all other pairs. For each bit, predictors give
log odds from counts seen in training: the tree node alone (order 2), hashed contexts of the last 4 and 6 bytes and of the previous word with what stands
of the present one (all of them across spaces), and a match predictor. A gate (how well the contexts are known, and the match) picks the weights that mix them.
The mixed odds are refined while the text is read: a map from (last two bytes, node, level of the odds) to how such bits
have turned out so far in this text draws each prediction towards what it has seen.

What is learned from the training texts, all of them whole:

* word counts for the base score, by a shuffle, and triples of bytes for the trees;
* counts of (context, node) pairs in hashed tables of fixed size (``SLOT_BITS``), summed by block;
* passages, a table that grows with the corpus: at content-defined anchors (a hash of 8 bytes chooses one place in 128; 24 bytes are the context) the
  ``AHEAD`` bytes that most often follow, where two documents or more have them. It is joined by anchor with the anchors of each part of the texts; the
  ``HOT_PASSAGES`` most frequent are known to every task, so no anchor that is joined is more than its share;
* the mixing weights, by online logistic regression over every training text, with each bit's own occurrence taken out of
  the counts; each task learns from its rows and the weights are averaged.

No text is shuffled: the texts are written once to the shared folder, in parts of about ``PART`` bytes, and what the join finds for a part is a table of
its own there, which the task that reads the part opens with pyarrow. Learning and scoring read the same parts.

Texts longer than ``PIECE`` bytes are read in pieces, whose contexts reach ``REACH`` bytes back; the map goes on.

Base score: the ``HOT`` most frequent words' counts are known to every task; the others are joined by word.

Cases: null text is empty: the end alone is scored; a null id is not held out; no training text leaves all
counts 0; repeated rows are counted and scored each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewater.llm._common import drop_stored, mix, new_path, part_of_stored, release, slices, stored, table, text_bytes

ORDERS, HASHED, SLOT_BITS = (4, 6), 3, 20  # the third: previous word with the present one so far
PREDICTORS = HASHED + 3  # with order 2, the match and a constant
TREES = 1024
HOT, HELD_BYTES = 400_000, 32 << 20
PIECE, REACH, CHUNK = 1 << 18, 512, 1 << 15
PART = 16 << 20
ANCHOR, EVERY_BITS, AHEAD, HOT_PASSAGES = 24, 7, 128, 1 << 14
LONG = 4  # documents with a passage from which its match is of the surer kind
BLOCK = 1 << 14
END, SPACE = 255, 32
GATES = 24
TRUST = 6.0  # what a mixed prediction counts beside the bits seen
SCALE = 1024  # of log odds in a table of inputs; their last two bits are the confidence
PRIME = 0xD1342543DE82EF95
INVERSE = pow(PRIME, -1, 1 << 64)
NODE, SPREAD = np.array([0x9E3779B1, 0x85EBCA6B], np.uint32)[:, None]  # arrays, whose products wrap without a warning
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Code:
    """Huffman codes over 256 bytes, one for each byte before and for each of some pairs before: the inner nodes on each path and the turns taken."""

    def __init__(self, single: np.ndarray, pairs: np.ndarray, follow: np.ndarray):
        """single: [byte before, byte] counts. follow: [k, byte] counts after the pair of bytes pairs[k] (earlier << 8 | later)."""
        #: the tree for each pair before
        self.tree = np.tile(np.arange(256, dtype=np.int32), 256)
        self.tree[pairs] = 256 + np.arange(len(pairs))
        trees = 256 + len(pairs)
        self.length, self.odds = np.zeros((trees, 256), np.int8), np.zeros((trees, 255), np.float32)
        path = []
        for k, counts in enumerate((*single, *follow)):
            heap = [(int(c) + 1, b) for b, c in enumerate(counts)]
            heapq.heapify(heap)
            inner: list[tuple[int, int]] = []
            while len(heap) > 1:
                (ca, a), (cb, b) = heapq.heappop(heap), heapq.heappop(heap)
                self.odds[k, len(inner)] = np.log(cb / ca)
                inner.append((a, b))
                heapq.heappush(heap, (ca + cb, 255 + len(inner)))
            paths: dict[int, list[tuple[int, int]]] = {510: []}
            for at in range(255, 0, -1):
                for way, child in enumerate(inner[at - 1]):
                    paths[child] = [*paths[255 + at], (at - 1, way)]
            self.length[k] = [len(paths[b]) for b in range(256)]
            steps = np.array([s for b in range(256) for s in paths[b]])
            path.append((k * 255 + steps[:, 0] << 1 | steps[:, 1]).astype(np.uint32))
        self.length = self.length.ravel()
        self.begin = np.cumsum(self.length, dtype=np.intp) - self.length
        #: each step of each path: the node, and in the low bit the turn
        self.path = np.concatenate(path)
        #: log odds of each node, from all training texts
        self.odds = self.odds.ravel()

    @functools.cached_property
    def node(self) -> np.ndarray:
        return self.path >> np.uint32(1)

    @functools.cached_property
    def turn(self) -> np.ndarray:
        return (self.path & np.uint32(1)).astype(np.uint8)

    def context(self, before: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where the codes of ``byte`` after each pair are in ``length`` and ``begin``."""
        return self.tree.take(before) << 8 | byte


#: A count in a byte: exact up to 32, then by twelfths of powers of two.
LEVELS = np.concatenate([np.arange(33), 32 * 2 ** (np.arange(1, 224) / 12)])


def packed_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    level = lambda c: (np.searchsorted(LEVELS, np.minimum(c, LEVELS[-1]) + 1e-6) - 1).astype(np.uint16)
    return level(ones) << np.uint16(8) | level(zeros)


def _looked_up(less_zeros: int, less_ones: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and confidence (0 to 3) of each packed pair of counts, with some taken out."""
    zeros, ones = np.maximum(LEVELS[None, :] - less_zeros, 0), np.maximum(LEVELS[:, None] - less_ones, 0)
    total = (zeros + ones).ravel()
    return np.log((ones + 0.3) / (zeros + 0.3)).ravel().astype(np.float32), np.searchsorted([0.5, 2.5, 16], total).astype(np.uint8)


def _inputs(odds: np.ndarray, sure: np.ndarray) -> np.ndarray:
    return (np.rint(odds * (SCALE / 4)) * 4 + sure).astype(np.int16)


INPUT = _inputs(*_looked_up(0, 0))
#: by the turn that a bit took (the high bit of 17): its own occurrence is left out
LEFT_OUT = np.concatenate([_inputs(*_looked_up(1, 0)), _inputs(*_looked_up(0, 1))])


class Symbols:
    """The bytes of some texts, or of a piece of one, with an end after each text, and their contexts as hashes."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, before: np.ndarray | None = None, last: bool = True):
        """at: where texts begin. ``before`` is what precedes a piece (one text); ``last``: the end symbol follows."""
        n = len(at) - 1
        lead = 6 if before is None else len(before)
        size = np.diff(at)
        own = size + lead + int(last)
        first = np.cumsum(own) - own
        whole = np.full(int(own.sum()), SPACE, np.uint8)
        self.text = np.repeat(np.arange(n, dtype=np.int32), size + int(last))
        at_new = np.arange(len(self.text)) + np.repeat((np.arange(n) + 1) * lead, size + int(last))
        if last:
            whole[first + own - 1] = END
        inside = whole[at_new]
        body = np.ones(len(at_new), bool)
        if last:
            body[np.cumsum(size + 1) - 1] = False
        inside[body] = raw
        whole[at_new] = inside
        if before is not None:
            whole[:lead] = before
        self.raw = whole[at_new]
        back = before_each(whole).take(at_new)
        self.before = (back & np.uint64(0xFFFF)).astype(np.intp)  # the last byte is the low one
        #: for each byte a hash for each hashed predictor, and one for the map, times SPREAD
        self.hashes = []
        for order in ORDERS:
            h = (back & np.uint64((1 << 8 * order) - 1)) + np.uint64(order)
            h ^= h >> np.uint64(23)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h >>= np.uint64(32)
            self.hashes.append(h.astype(np.uint32) * SPREAD)
        blank = whole <= SPACE
        up, down = powers(len(whole))
        total = np.zeros(len(whole) + 1, np.uint64)
        np.cumsum(BYTE[whole] * up, out=total[1:])
        place = np.arange(len(whole) + 1)
        start = np.zeros(len(whole) + 1, np.int64)  # where the word before each position begins
        start[1:] = np.maximum.accumulate(np.where(blank, place[1:], 0))
        start[:-1] = np.maximum(start[:-1], np.repeat(first, own))
        ends = np.flatnonzero(np.concatenate([[False], blank[1:] & ~blank[:-1]]))
        words = np.concatenate([np.zeros(1, np.uint64), mix((total[ends] - total[start[ends]]) * down[start[ends]] + np.uint64(1))])
        words[1:][np.isin(ends, first)] = 0  # the word that ended is another text's
        done = np.cumsum(np.bincount(ends, minlength=len(whole)))  # words ended up to and with each position
        begin = start[at_new]
        word = words[np.where(begin > 0, done[np.maximum(begin - 1, 0)], 0)]
        prefix = (total[at_new] - total[begin]) * down[begin]
        h = mix(prefix + word * np.uint64(PRIME) + (at_new - begin).astype(np.uint64))
        self.hashes.append((h >> np.uint64(32)).astype(np.uint32) * SPREAD)
        self.hashes.append(self.before.astype(np.uint32) * (NODE * SPREAD))


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", PRIME), ("down", INVERSE)):
            _POWERS[name] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def before_each(whole: np.ndarray) -> np.ndarray:
    """The eight bytes before each place as one number, the last one its low byte; spaces stand before the first."""
    n = len(whole)
    padded = np.concatenate([np.full(8, SPACE, np.uint8), whole])
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        m = (n + 7 - k) // 8
        out[k::8] = padded[k : k + 8 * m].view(">u8")
    return out


class Bits:
    """The bits of some symbols by depth. Bytes with longer paths come first, so that each depth has a prefix of them."""

    def __init__(self, symbols: Symbols, code: Code):
        at = code.context(symbols.before, symbols.raw)
        length = code.length.take(at)
        self.code = code
        #: places of the bytes in this order
        self.order = np.argsort(-length, kind="stable")
        self.step = code.begin.take(at.take(self.order))
        self.hashes = [h.take(self.order) for h in symbols.hashes]
        self.length = length
        #: how many bytes reach each depth
        self.reach = len(length) - np.cumsum(np.bincount(length))[:-1]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
        """For each depth: nodes, turns, the slots of each predictor in its own table, and hashes for the map."""
        for depth, m in enumerate(self.reach.tolist()):
            path = self.code.path.take(self.step[:m] + depth, mode="clip")
            node = path >> np.uint32(1)
            own = node * (NODE * SPREAD)
            slots = [(h[:m] + own) >> np.uint32(32 - SLOT_BITS) for h in self.hashes[:HASHED]]
            yield node, (path & np.uint32(1)).astype(np.uint8), slots, self.hashes[HASHED][:m] + own


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash of the 24 bytes before, which are of the same text) of the places whose last 8 bytes have a hash of the chosen kind."""
    n = len(raw) - 7
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    eight = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        m = (n + 7 - k) // 8
        eight[k::8] = raw[k : k + 8 * m].view("<u8")
    place = np.flatnonzero(eight * np.uint64(PRIME) >> np.uint64(64 - EVERY_BITS) == 0) + 8
    text = np.searchsorted(at, place - 1, "right") - 1
    inside = place - ANCHOR >= at[text]
    place, text = place[inside], text[inside]
    key = mix(mix(eight[place - 24] * np.uint64(PRIME) + eight[place - 16]) + eight[place - 8])
    return text, place, key.view(np.int64)


def with_ends(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with an end symbol each."""
    n = len(at) - 1
    out = np.full(int(at[-1] - at[0]) + n, END, np.uint8)
    out[np.arange(at[-1] - at[0]) + np.repeat(np.arange(n), np.diff(at))] = raw[at[0] : at[-1]]
    return out, at - at[0] + np.arange(n + 1)


def matches(raw: np.ndarray, at: np.ndarray, known: list[dict], hot: dict, least: int) -> tuple[np.ndarray, np.ndarray] | None:
    """For texts with ends: the byte that a passage predicts at each place, and the match's state (0: none, 1, 2: one of more documents).

    A passage predicts up to and with the first byte that it gets wrong; where several do, the one that began first. Those
    in fewer documents than ``least`` say nothing.
    """
    byte, state, upto = None, None, 0
    for text, a, key in zip(*(c.tolist() for c in anchors(raw, at)), strict=True):
        end = int(at[text + 1])
        if a < upto or a >= end:
            continue
        got = known[text].get(key) or hot.get(key)
        if got is None or got[1] < least:
            continue
        if byte is None:
            byte, state = np.zeros(len(raw), np.uint8), np.zeros(len(raw), np.uint8)
        ahead = np.frombuffer(got[0], np.uint8)[: end - a]
        wrong = np.flatnonzero(ahead != raw[a : a + len(ahead)])
        upto = a + (int(wrong[0]) + 1 if len(wrong) else len(ahead))
        byte[a:upto], state[a:upto] = ahead[: upto - a], 1 if got[1] < LONG + least - 2 else 2
    return None if byte is None else (byte, state)


class Mixer:
    """What mixes predictions: trees, tables of packed counts, and weights [predictor, gate]."""

    def __init__(self, code: Code, tables: np.ndarray, weights: np.ndarray | None = None):
        self.code, self.tables = code, tables
        self.weights = np.full((PREDICTORS, GATES), 0.25, np.float32) if weights is None else weights
        if weights is None:
            self.weights[-2], self.weights[-1] = 1.0, 0.0
        else:
            self.inputs = INPUT.take(tables)
        self.turned()

    def turned(self) -> None:
        """Weights for inputs as the tables have them, a row for each gate."""
        self.scaled = self.weights.T.copy()
        self.scaled[:, 1 : 1 + HASHED] /= SCALE

    def bits(self, symbols: Symbols, match: tuple[np.ndarray, np.ndarray] | None, leave_out: bool) -> Iterator[tuple]:
        """For each depth: hashes for the map, turns, gates (so many are in use) and the predictors' inputs as rows, in the order of ``Bits``, which comes first."""
        code, own = self.code, Bits(symbols, self.code)
        yield own
        values = (self.tables if leave_out else self.inputs).reshape(HASHED, -1)
        if match is not None:
            # the predicted byte's path holds while all turns agree with it
            byte, state = match
            guessed = code.begin.take(code.context(symbols.before, byte).take(own.order))
            state = state.take(own.order)
        for depth, (node, turn, slots, spot) in enumerate(own):
            x = np.empty((PREDICTORS, len(node)), np.float32)
            x[0], x[-1], x[-2] = code.odds.take(node, mode="clip"), 1, 0
            high = turn.astype(np.intp) << 16 if leave_out else None
            for k, (v, slot) in enumerate(zip(values, slots, strict=True)):
                got = v.take(slot.astype(np.intp), mode="clip")
                if leave_out:
                    got = LEFT_OUT.take(high | got, mode="clip")
                x[1 + k] = got
                if k == 0:
                    gate = got & np.int16(3)
            gate |= np.minimum(got & np.int16(3), np.int16(1)) << np.int16(2)
            if match is not None:
                told = state[: len(node)]
                some = np.flatnonzero(told)
                guess = (code.path.take(guessed.take(some) + depth) & np.uint32(1)).astype(np.uint8)
                x[-2, some] = 2 * guess.astype(np.float32) - 1
                gate += told.astype(np.int16) << np.int16(3)
                state[some[guess != turn.take(some)]] = 0
            yield spot, turn, gate, GATES if match is not None else 8, x

    def mixed(self, gate: np.ndarray, gates: int, x: np.ndarray) -> np.ndarray:
        """Log odds: those of all gates, of which each bit's own is taken."""
        out = self.scaled[:gates] @ x
        return out.ravel().take(gate.astype(np.intp) * x.shape[1] + np.arange(x.shape[1]), mode="clip")

    def learn(self, symbols: Symbols, match: tuple[np.ndarray, np.ndarray] | None, heat: np.ndarray, seen: np.ndarray) -> None:
        """A step of online logistic regression for each depth; seen: bits of each gate so far."""
        bits = self.bits(symbols, match, True)
        next(bits)
        for _, turn, gate, gates, x in bits:
            wrong = turn - chance(self.mixed(gate, gates, x), 30)
            n = np.bincount(gate, minlength=GATES)
            step = np.zeros((PREDICTORS, GATES))
            step[:, :gates] = x @ np.where(gate == np.arange(gates, dtype=np.int16)[:, None], wrong, np.float32(0)).T
            step[1 : 1 + HASHED] /= SCALE
            step /= np.maximum(n, 1)
            heat += step * step
            self.weights = (self.weights + 0.05 * step / np.sqrt(heat + 1e-8)).astype(np.float32)
            self.turned()
            seen += n

    def score(self, symbols: Symbols, match: tuple[np.ndarray, np.ndarray] | None, n: int, map_: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each of the n texts; map_: what earlier pieces of this text have left, [bucket, (zeros, ones)]."""
        cost = np.zeros(n)
        left = None if map_ is None else np.zeros_like(map_)
        bits = self.bits(symbols, match, False)
        own = next(bits)
        # text (13 bits), place (25) and turn, under a key of 16 bits: in a bucket by text, in the text by place
        assert n < 1 << 13 and len(own.order) < 1 << 25
        place = (symbols.text.take(own.order).astype(np.uint64) << np.uint64(25) | own.order.astype(np.uint64)) << np.uint64(1)
        rank = np.empty(len(own.order), np.intp)
        rank[own.order] = np.arange(len(own.order))
        for spot, turn, gate, gates, x in bits:
            p = chance(self.mixed(gate, gates, x), 14)
            key = spot >> np.uint32(18) << np.uint32(2) | (p * np.float32(3.999)).astype(np.uint32)
            p, text = refined(p, key.astype(np.uint64) << np.uint64(39) | place[: len(p)] | turn, rank, map_, left)
            cost += np.bincount(text, np.log(p), n)
        if map_ is not None:
            map_ += left
        return cost / np.log(10)


def chance(z: np.ndarray, most: float) -> np.ndarray:
    """The probability that log odds stand for, these cut at ``most``."""
    np.clip(z, -most, most, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def refined(p: np.ndarray, key: np.ndarray, rank: np.ndarray, before: np.ndarray | None, left: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The chance of the turn that each bit took: by p, drawn to the share of that turn among the bits with the same bucket that came earlier in the same text; texts.

    It is made from that turn's own count: less the other's chance, it would be 0 where that one rounds to 1.

    key: bucket, text, place and turn of each bit. The results are in the keys' order; rank: where in p a place is.
    """
    key.sort()
    p = p.take(rank.take((key >> np.uint64(1) & np.uint64((1 << 25) - 1)).view(np.int64), mode="clip"), mode="clip")
    ones = (key & np.uint64(1)).astype(np.int32)
    text = key >> np.uint64(26)
    first = np.flatnonzero(text[1:] != text[:-1])
    first += 1
    first = np.concatenate([[0], first])
    size = np.diff(first, append=len(p))
    earlier = np.cumsum(ones, dtype=np.int32) - ones
    n1 = (earlier - np.repeat(earlier.take(first), size)).astype(np.float32)
    n = (np.arange(len(p), dtype=np.int32) - np.repeat(first.astype(np.int32), size)).astype(np.float32)
    turn = ones != 0
    taken = np.where(turn, n1, n - n1)
    if before is not None:
        bucket = (key >> np.uint64(39)).view(np.int64)
        n, taken = n + before[bucket].sum(1), taken + before[bucket, ones]
        left += np.stack([np.bincount(bucket[ones == t], minlength=1 << 16) for t in (0, 1)], 1)
    taken += np.float32(TRUST) * np.where(turn, p, 1 - p)
    n += np.float32(TRUST)
    taken /= n
    return taken, (text & np.uint64((1 << 13) - 1)).view(np.int64)


def blocks(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``CHUNK`` bytes; a text over ``PIECE`` bytes is alone."""
    size, a = np.diff(at), 0
    while a < len(size):
        b, total = a + 1, int(size[a])
        while b < len(size) and total + size[b] <= CHUNK and b - a < 4096:
            total += int(size[b])
            b += 1
        yield a, b
        a = b


def pieces(raw: np.ndarray, at: np.ndarray, a: int, b: int) -> Iterator[tuple[Symbols, slice]]:
    """Texts a to b as symbols: at once, or one long text piece by piece; and which of their bytes, ends counted."""
    if at[b] - at[a] <= PIECE or b - a > 1:
        yield Symbols(raw[at[a] : at[b]], at[a : b + 1] - at[a]), slice(0, int(at[b] - at[a]) + b - a)
        return
    text = raw[at[a] : at[b]]
    for x in range(0, len(text), PIECE):
        y = min(len(text), x + PIECE)
        last = y == len(text)
        before = np.concatenate([np.full(6, SPACE, np.uint8), text[max(0, x - REACH) : x]])
        yield Symbols(text[x:y], np.array([0, y - x]), before, last), slice(x, y + int(last))


class Words:
    """The words of some texts, lower-cased, each distinct one once."""

    def __init__(self, column: pa.Array):
        # ascii_lower takes an array's first offset for 0, which it is not where a slice was cast: other rows' bytes would be read
        raw, at = text_bytes(column)
        texts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw))
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        at = split.offsets.to_numpy()
        flat = split.values.slice(int(at[0]), int(at[-1] - at[0]))
        some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        self.at = np.concatenate([[0], np.cumsum(some)])[at - at[0]]
        self.codes = coded.indices.to_numpy(zero_copy_only=False)[some]
        self.distinct = coded.dictionary.cast(pa.large_binary())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []

    def rows() -> pa.RecordBatch:
        whole = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).combine_chunks()
        held.clear()
        return pa.RecordBatch.from_arrays([whole["word"].combine_chunks().cast(pa.binary()), whole["n_sum"].combine_chunks()], ["word", "n"])

    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(batch.column("text"))
            n = np.bincount(words.codes, minlength=len(words.distinct))
            some = pa.array(n > 0)
            held.append(pa.table({"word": words.distinct.filter(some), "n": pa.array(n).filter(some)}))
            if sum(t.nbytes for t in held) > HELD_BYTES:
                yield rows()
    if held:
        yield rows()


def _triple_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triples of neighbouring bytes, and (triple -1) the number of texts; spaces stand before a text."""
    total, texts = np.zeros(1 << 24, np.uint32), 0
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, at = with_ends(*text_bytes(batch.column("text")))
            one, two = np.full(len(raw), SPACE, np.intp), np.full(len(raw), SPACE, np.intp)
            one[1:], two[2:] = raw[:-1], raw[:-2]
            one[at[:-1]] = two[at[:-1]] = SPACE
            second = at[:-1][np.diff(at) > 1] + 1
            two[second] = SPACE
            np.add.at(total, two << 16 | one << 8 | raw, np.uint32(1))
            texts += batch.num_rows
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some].astype(np.int64), texts))], ["triple", "n"])


def made_code(triples: DataFrame) -> Code:
    """triples: (triple, n), each once. At most 256 x 256 + TREES x 256 counts come to the driver."""
    single, follow = np.zeros((256, 256), np.int64), np.zeros((TREES, 256), np.int64)
    triples = triples.where("triple >= 0")
    for r in triples.groupBy(F.col("triple").bitwiseAND(0xFFFF)).agg(F.sum("n")).collect():
        single[r[0] >> 8, r[0] & 255] = r[1]
    pair = F.shiftright("triple", 8).alias("pair")
    pairs = [r[0] for r in triples.groupBy(pair).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(TREES).collect()]
    place = {p: k for k, p in enumerate(pairs)}
    for r in triples.where(F.shiftright("triple", 8).isin(pairs)).collect() if pairs else ():
        follow[place[r[0] >> 8], r[0] & 255] = r[1]
    return Code(single, np.array(pairs, np.int64), follow[: len(pairs)])


def _table_blocks(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    code = shared.value
    counts = np.zeros((HASHED, 2 << SLOT_BITS), np.uint32)
    held, places = 0, np.empty((HASHED, 1 << 22), np.uint32)

    def add() -> None:
        for own, at in zip(counts, places[:, :held], strict=True):
            own += np.bincount(at, minlength=len(own)).astype(np.uint32)

    for whole in batches:
        for batch in slices(whole, "text"):
            raw, at = text_bytes(batch.column("text"))
            for a, b in blocks(raw, at):
                for symbols, _ in pieces(raw, at, a, b):
                    for _, turn, slots, _ in Bits(symbols, code):
                        if held + len(turn) > places.shape[1]:
                            add()
                            held = 0
                        for own, slot in zip(places, slots, strict=True):
                            own = own[held : held + len(turn)]
                            np.left_shift(slot, np.uint32(1), out=own)
                            own |= turn
                        held += len(turn)
    add()
    parts = counts.reshape(-1, BLOCK)
    some = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([shrunk(parts[b]) for b in some], pa.binary())], ["block", "packed"])


def shrunk(counts: np.ndarray) -> bytes:
    """32-bit counts, first the low bytes of all, compressed."""
    return pa.compress(counts.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def grown(packed: pa.Buffer, n: int) -> np.ndarray:
    """The n counts of ``shrunk``."""
    planes = np.frombuffer(pa.decompress(packed, 4 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.uint32).ravel()


def _summed(group: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for x in group["packed"]:
        total += grown(x.as_buffer(), BLOCK)
    packed = packed_counts(total[::2], total[1::2])
    return pa.table({"block": group["block"].slice(0, 1), "packed": pa.array([packed.tobytes()], pa.binary())})


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct anchors, with what first follows."""
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, at = text_bytes(batch.column("text"))
            raw, at = with_ends(raw, at)
            text, place, key = anchors(raw, at)
            by = np.lexsort((place, key, text))
            text, place, key = text[by], place[by], key[by]
            new = np.ones(len(by), bool)
            new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
            new &= place < at[text + 1]
            text, place, key = text[new], place[new], key[new]
            upto = np.minimum(place + AHEAD, at[text + 1])
            after = [raw[a:b].tobytes() for a, b in zip(place.tolist(), upto.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(after, pa.binary())], ["key", "ahead"])


def _numbered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows with ``part``: runs of about ``most`` bytes of a task's rows."""
    part, held = TaskContext.get().partitionId() << 32, 0
    for whole in batches:
        for batch in slices(whole, "text", min(most, 4 << 20)):
            if held > most:
                part, held = part + 1, 0
            held += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part))], [*batch.schema.names, "part"])


def in_parts(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a table of the shared folder, with ``part``; the rows of a part are neighbours in one file."""
    most = PART
    return stored(docs.mapInArrow(lambda b: _numbered(b, most), StructType([*docs.schema.fields, StructField("part", LongType())])), "mixing-texts", "zstd")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for whole in batches:
        part = whole.column("part").to_numpy()
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
            for batch in slices(whole.slice(a, b - a), "text"):
                yield int(part[a]), batch


def _part_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, key): each part's distinct anchors."""

    def rows() -> pa.RecordBatch:
        keys = np.unique(np.concatenate(held))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), last)), pa.array(keys)], ["part", "key"])

    last, held = -1, []
    for part, batch in _by_part(batches):
        if held and part != last:
            yield rows()
        last = part
        held.append(anchors(*with_ends(*text_bytes(batch.column("text"))))[2])
    if held:
        yield rows()


def _with_found(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Batches of one part each, with the passages at its anchors."""
    last, found = -1, {}
    for part, batch in _by_part(batches):
        if part != last:
            last, found = part, {}
            if (rows := part_of_stored(path, "part", part)) is not None:
                found = dict(zip(rows["key"].to_pylist(), zip(rows["ahead"].to_pylist(), rows["n"].to_pylist(), strict=True), strict=True))
        yield batch, found


def passages(docs: DataFrame) -> DataFrame:
    """(key, ahead, n): what most often follows an anchor, where it does in two documents or more."""
    rows = docs.select("text").mapInArrow(_followed, "key long, ahead binary")
    often = rows.groupBy("key", "ahead").agg(F.count("*").alias("n")).where("n > 1")
    best = often.groupBy("key").agg(F.max(F.struct("n", "ahead")).alias("best"))
    return best.select("key", F.col("best.ahead").alias("ahead"), F.col("best.n").alias("n"))


def least_of_hot(rows: DataFrame, most: int) -> int:
    """The power of two from which at most ``most`` rows have so large an n."""
    least, total = 1 << 62, 0
    for r in rows.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > most:
            break
        least = 1 << r["level"]
    return least


def _learned(batches: Iterator[pa.RecordBatch], shared, hot, path: str) -> Iterator[pa.RecordBatch]:
    mixer, heat, seen = Mixer(*shared.value), np.zeros((PREDICTORS, GATES)), np.zeros(GATES, np.int64)
    for batch, found in _with_found(batches, path):
        for symbols, match, *_ in _read(batch, hot.value, 3, found):
            mixer.learn(symbols, match, heat, seen)
    total = mixer.weights.astype(np.float64) * seen
    rows = [(k, g, total[k, g], int(seen[g])) for k in range(PREDICTORS) for g in range(GATES) if seen[g]]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64()))], ["predictor", "gate", "total", "n"])


def _read(batch: pa.RecordBatch, hot: dict, least: int, found: dict | None = None) -> Iterator[tuple]:
    """The symbols of a batch and their matches; first text and number of texts; whether it is the first piece. found: passages of all its texts, else a column has each text's."""
    raw, at = text_bytes(batch.column("text"))
    extra = batch.column("found").to_pylist() if found is None else None
    for a, b in blocks(raw, at):
        known = [found] * (b - a) if extra is None else [{f["key"]: (f["ahead"], f["n"]) for f in own or ()} for own in extra[a:b]]
        match = matches(*with_ends(raw, at[a : b + 1]), known, hot, least)
        for k, (symbols, which) in enumerate(pieces(raw, at, a, b)):
            yield symbols, None if match is None else (match[0][which], match[1][which]), a, b - a, k == 0


class Trained:
    """Counts of a corpus (tables in the shared folder) and the model made from them."""

    def __init__(self, docs: DataFrame, among: DataFrame | None = None):
        """docs: doc_id, text. among: a table of ``in_parts`` of which docs are some rows, and which will be scored."""
        self.spark = spark = docs.sparkSession
        own = None
        if among is None:
            docs, own = in_parts(docs.select("text"))
        texts = docs.select("text")
        self.words, words_path = stored(texts.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "mixing-words")
        sums = self.words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        triples, triples_path = stored(texts.mapInArrow(_triple_counts, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")), "mixing-triples")
        self.texts = triples.where("triple = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.n, self.v = sums[0] + self.texts, sums[1] + (self.texts > 0)
        self.least = least_of_hot(self.words, HOT)
        hot = self.words.where(F.col("n") >= self.least).toArrow()
        self.hot_words = spark.sparkContext.broadcast((hot["word"].combine_chunks().cast(pa.large_binary()), np.append(hot["n"].to_numpy(), 0)))
        code = made_code(triples)
        drop_stored(spark, triples_path)
        self.passages, passages_path = stored(passages(texts), "mixing-passages")
        release(spark)
        self.least_passage = least_of_hot(self.passages, HOT_PASSAGES)
        hot = self.passages.where(F.col("n") >= self.least_passage).toArrow()
        self.hot_passages = spark.sparkContext.broadcast(dict(zip(hot["key"].to_pylist(), zip(hot["ahead"].to_pylist(), hot["n"].to_pylist(), strict=True), strict=True)))
        self.among, found = among, self.found(docs if among is None else among)
        shared = spark.sparkContext.broadcast(code)
        summed = texts.mapInArrow(lambda b: _table_blocks(b, shared), "block int, packed binary").groupBy("block").applyInArrow(_summed, "block int, packed binary")
        tables = np.zeros(HASHED << SLOT_BITS, np.uint16)
        for block, packed in summed.toLocalIterator():
            tables[block * BLOCK // 2 : (block + 1) * BLOCK // 2] = np.frombuffer(packed, np.uint16)
        del summed  # a plan that is held keeps its shuffle files
        release(spark)
        start = spark.sparkContext.broadcast((code, tables))
        hot = self.hot_passages
        learned = docs.select("part", "text").mapInArrow(lambda b: _learned(b, start, hot, found), "predictor int, gate int, total double, n long").groupBy("predictor", "gate").agg(F.sum("total"), F.sum("n"))
        weights = Mixer(code, tables).weights
        for k, g, total, n in learned.collect():
            weights[k, g] = total / n
        start.destroy()
        del learned
        release(spark)
        self.model = spark.sparkContext.broadcast((code, tables, weights))
        self.paths = [words_path, passages_path]
        if own:
            drop_stored(spark, own)
            drop_stored(spark, found)
        else:
            self.found_among = found

    def found(self, docs: DataFrame) -> str:
        """The folder of a table by part: the passages at the anchors of docs (text, part) that not every task knows."""
        path = new_path(self.spark, "mixing-found")
        rare = self.passages.where(F.col("n") < self.least_passage)
        keys = docs.select("part", "text").mapInArrow(_part_keys, "part long, key long")
        keys.join(rare, "key").repartition("part").write.partitionBy("part").parquet(path)
        release(self.spark)
        return path

    def done(self) -> None:
        """Delete the tables; what was made with them has to be written by then."""
        for path in self.paths:
            drop_stored(self.spark, path)


def _scored(batches: Iterator[pa.RecordBatch], shared, hot_words, hot_passages, path: str) -> Iterator[pa.RecordBatch]:
    mixer, (hot, counts) = Mixer(*shared.value), hot_words.value
    for batch, passages_ in _with_found(batches, path):
        words = Words(batch.column("text"))
        found = pc.fill_null(pc.index_in(words.distinct, value_set=hot), -1).to_numpy(zero_copy_only=False)
        n = counts[found]
        known = (n > 0)[words.codes]
        row = np.repeat(np.arange(batch.num_rows), np.diff(words.at))
        known_of = np.bincount(row[known], minlength=batch.num_rows)
        gain_of = np.bincount(row, np.log10(n + 1.0)[words.codes], batch.num_rows).astype(np.float64)  # by row: what others add up to costs no digits; integers where there is no word
        rare = np.flatnonzero(~known)
        others = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(rare, words.at)), words.distinct.take(pa.array(words.codes[rare]))).cast(pa.list_(pa.binary()))
        score, map_ = np.zeros(batch.num_rows), None
        for symbols, match, a, n, first in _read(batch, hot_passages.value, 2, passages_):
            if first:
                map_ = np.zeros((1 << 16, 2), np.float32) if len(symbols.raw) >= PIECE else None
            score[a : a + n] += mixer.score(symbols, match, n, map_)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(words.at) + 1), pa.array(known_of), pa.array(gain_of), pa.array(np.round(score, 5)),
             pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64()), others],
            ["doc_id", "held_out", "n_tokens", "hot_known", "hot_score", "score", "n_bytes", "rare"],
        )


def score(docs: DataFrame, trained: Trained) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of docs (doc_id, held_out, text)."""
    model, words, hot = trained.model, trained.hot_words, trained.hot_passages
    kind = docs.schema["doc_id"].dataType.simpleString()
    if docs is trained.among:
        path, own, trained.among = trained.found_among, None, None
    else:
        docs, own = in_parts(docs.select("doc_id", "held_out", "text"))
        path = trained.found(docs)
    rows = docs.select("doc_id", "held_out", "text", "part").mapInArrow(
        lambda b: _scored(b, model, words, hot, path), f"doc_id {kind}, held_out boolean, n_tokens long, hot_known long, hot_score double, score double, n_bytes long, rare array<binary>"
    )
    rows, _ = stored(rows, "mixing-scored")
    drop_stored(docs.sparkSession, path)
    if own:
        drop_stored(docs.sparkSession, own)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rare = rows.select("row", F.explode("rare").alias("word")).join(trained.words.where(F.col("n") < trained.least), "word").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("gain"))
    end = int(trained.texts > 0)
    known = F.col("hot_known") + F.coalesce("more", F.lit(0)) + end
    base = F.col("hot_score") + F.coalesce("gain", F.lit(0.0)) + F.log10(F.lit(trained.texts + 1.0)) - F.col("n_tokens") * F.log10(F.lit(trained.n + trained.v + 1.0))
    return rows.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(trained.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") * F.log2(F.lit(10.0)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = in_parts(table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"))
    rows = score(docs, Trained(docs.where(~F.col("held_out")), docs))
    drop_stored(spark, path)
    return rows
