"""N-gram Jaccard join: token-combination prefixes, then exact verification.

A document's set is its distinct 4-word shingles, as 64-bit hashes. Documents with equal sets are one class
(named by a hash of the set), so copies never meet as pairs.

All shingles have one order: rare ones first, then those of frequent classes (powers of two of
the document frequency), then those that are not counted. Sets with Jaccard similarity t share at least k shingles among the first
n - ceil(t n) + k of each, the first k that they share at all. So:

* rare shingles of the prefix for k = 1 are indexed singly. That is all a set needs whose whole prefix is rare: the first shingle
  that it shares with a similar one is there.
* Else the prefix is extended to k = B + 1, and its other shingles are dealt by hash into B buckets and indexed in combinations of two within a bucket. If
  the first shared shingle isn't rare, none is, so B + 1 shared ones fall into B buckets and some bucket has two of them. B is a twelfth of the
  least size of a size class (powers of two), so that a set has about half as many combinations as shingles, whatever its size.
  Two similar sets use the class of the larger: a set near the end of its class is indexed for the next one too.

Document frequencies count all documents, for the quarter of shingles with the lowest hashes: these fill
most prefixes, and a shingle's place in the order is its own affair, so any rule gives right results.
At most ``FREQUENT`` of them, the most frequent, are known to every task; those not counted are treated like frequent ones.

Within a posting list, sets are compared in rounds. First each with the list's smallest (linear in
the list). Then, in lists whose members are not yet in one component, pairs across components, unless a
512-bit parity sketch proves them apart: the sketches of two sets differ in no more bits than the sets in
shingles. A list with many such pairs gives a spanning forest of them, the likeliest links first, and all that are
still across components after these have been verified. Pairs are verified on whole sets. Skipped pairs lie within one component, so
components are exact; ``all_links`` skips none and returns every pair of classes.

Cases: null or empty text, or one without words, has an empty set and is linked with nothing; fewer than four words are one
shingle; repeated rows are each in the result; a null id is no smallest id; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewater.llm._common import drop_stored, mix, release, shuffle_partitions, slices, stored, table, text_bytes, trim, trimmed
from tidewater.llm.components import connected_components

WORDS, PERCENT = 4, 85
FREQUENT, LEAST_DF, LOW_BITS = 1 << 19, 8, 2
BUCKET = 12  # shingles of a set for each bucket of combinations
SKETCH = 512
SLICE, WINDOW = 2 << 20, 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PLACE = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
BASE = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            _POWERS[name] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many words each document has."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    ink = ~WHITE[raw]
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | begins[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | begins[1:n]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    words, x = np.empty(len(a), np.uint64), 0
    while x < len(a):  # a hash does not depend on where its window begins
        y = max(x + 1, int(np.searchsorted(b, a[x] + WINDOW, "right")))
        from_, upto = int(a[x]), int(b[y - 1])
        up, down = powers(upto - from_)
        total = np.zeros(upto - from_ + 1, np.uint64)
        np.cumsum(BYTE[LOWER[raw[from_:upto]]] * up, out=total[1:])
        p, q = a[x:y] - from_, b[x:y] - from_
        words[x:y] = mix((total[q] - total[p]) * down[p] + (q - p).astype(np.uint64) * PLACE[15])
        x = y
    return words, np.diff(np.searchsorted(a, at))


class Sets:
    """Shingle sets of the texts of a column: sorted, one after the other."""

    def __init__(self, column: pa.Array, words: int = WORDS):
        raw, at = text_bytes(column)
        w, n = word_hashes(raw, at)
        ends = np.cumsum(n)
        begins = ends - n
        doc = np.repeat(np.arange(len(n)), n)
        many = max(0, len(w) - words + 1)
        s = np.zeros(many, np.uint64)
        for k in range(words):
            s += w[k : k + many] * PLACE[k]
        inside = doc[:many] == doc[words - 1 :] if many else np.zeros(0, bool)
        s, own = s[inside], doc[:many][inside]
        short = np.flatnonzero((n > 0) & (n < words))
        if len(short):
            rest = np.array([sum(int(w[begins[d] + k]) * int(PLACE[k]) for k in range(n[d])) + int(n[d]) * int(PLACE[14]) & (1 << 64) - 1 for d in short], np.uint64)
            s, own = np.concatenate([s, rest]), np.concatenate([own, short])
        s = mix(s)
        by = np.lexsort((s, own))
        s, own = s[by], own[by]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
        self.tokens, self.doc = s[new], own[new]
        self.n = np.bincount(self.doc, minlength=len(n)).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.tokens ^ PLACE[12]))])
        self.cls = mix(total[self.at[1:]] - total[self.at[:-1]] + self.n.astype(np.uint64) * PLACE[11]).view(np.int64)

    def first_of_class(self) -> np.ndarray:
        """Documents with a set, one of each class."""
        some = np.flatnonzero(self.n > 0)
        return some[np.unique(self.cls[some], return_index=True)[1]]

    def sketches(self) -> np.ndarray:
        """Parity of the number of shingles in each of SKETCH buckets."""
        slot = self.doc * SKETCH + (mix(self.tokens ^ PLACE[13]) >> np.uint64(64 - 9)).astype(np.int64)
        bits = np.bincount(slot, minlength=len(self.n) * SKETCH) & 1
        return np.packbits(bits.astype(np.uint8).reshape(-1, SKETCH), axis=1)


def _classes(batches: Iterator[pa.RecordBatch], bits: int, words: int) -> Iterator[pa.RecordBatch]:
    """A row for each document; and packed shingles by block of their hash, for the frequencies."""
    names = ["doc_id", "n", "cls", "sketch", "block", "packed"]
    for whole in batches:
        low = []
        for batch in slices(whole, "text", SLICE):
            sets = Sets(batch.column("text"), words)
            sketch = sets.sketches()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets.n), pa.array(sets.cls), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], names)
            own = np.isin(sets.doc, sets.first_of_class())
            t = sets.tokens[own]
            low.append(t[t >> np.uint64(64 - LOW_BITS) == 0])
        if low:
            t = np.sort(np.concatenate(low))
            cuts = np.searchsorted(t, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(64 - LOW_BITS - bits))
            short = (t >> np.uint64(32 - LOW_BITS - bits)).astype(np.uint32)
            rows = [(b, short[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
            k = len(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, batch.schema.field(0).type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)


def _frequent(group: pa.Table) -> pa.Table:
    """Shingles of a block with their frequency class."""
    values, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group["packed"]]), return_counts=True)
    often = n >= LEAST_DF
    short = group["block"][0].as_py() << 32 | values[often].astype(np.int64)
    return pa.table({"short": pa.array(short, pa.int64()), "level": pa.array(np.log2(n[often]).astype(np.int32), pa.int32())})


def _prefixes(batches: Iterator[pa.RecordBatch], shared, bits: int, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    short, level = shared.value
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            sets = Sets(batch.column("text"), words)
            chosen = sets.first_of_class()
            own = np.isin(sets.doc, chosen[sets.n[chosen] > 1])
            t, doc = sets.tokens[own], sets.doc[own]
            rank = np.where(t >> np.uint64(64 - LOW_BITS) == 0, 0, 63)
            if len(short):
                low = np.flatnonzero(rank == 0)
                key = (t[low] >> np.uint64(32 - LOW_BITS - bits)).astype(np.int64)
                k = np.minimum(np.searchsorted(short, key), len(short) - 1)
                rank[low] = np.where(short[k] == key, 1 + level[k], 0)
            by = np.argsort(doc * 64 + rank, kind="stable")
            t, doc, rank = t[by], doc[by], rank[by]
            start = np.zeros(len(sets.n) + 1, np.int64)
            np.cumsum(np.bincount(doc, minlength=len(sets.n)), out=start[1:])
            keys, docs = prefix_keys(t, doc, rank, np.arange(len(t)) - start[doc], sets.n, percent)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sets.n[docs]), pa.array(sets.cls[docs])], ["token", "n", "cls"])


def size_class(n: np.ndarray) -> np.ndarray:
    """The greatest power of two up to n."""
    return np.int64(1) << (np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1)


def prefix_keys(t: np.ndarray, doc: np.ndarray, rank: np.ndarray, place: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which sets are indexed, and whose they are. Shingles t come by set in the common order, with their rank (0: rare) and place; size: of each set."""
    n = size[doc]
    spare = n - -(-percent * n // 100)  # n - ceil(t n)
    single = (rank == 0) & (place <= spare)
    keys, owners = [t[single]], [doc[single]]
    open_ = np.zeros(len(size), bool)
    open_[doc[(rank > 0) & (place <= spare)]] = True
    own = size_class(np.maximum(size, 1))
    for cls in (own, size_class(np.maximum(100 * size // percent, 1))):
        some = open_ if cls is own else open_ & (cls != own)
        buckets = np.maximum(1, cls // BUCKET)
        inside = np.flatnonzero(some[doc] & (rank > 0) & (place <= spare + buckets[doc]))
        if not len(inside):
            continue
        x, d = t[inside], doc[inside]
        salt = mix(cls[d].astype(np.uint64) * PLACE[10])
        bucket = ((mix(x ^ PLACE[7]) >> np.uint64(32)) % buckets[d].astype(np.uint64)).astype(np.int64)
        by = np.lexsort((x, bucket, d))
        x, d, bucket, salt = x[by], d[by], bucket[by], salt[by]
        new = np.ones(len(x), bool)
        new[1:] = (d[1:] != d[:-1]) | (bucket[1:] != bucket[:-1])
        end = np.append(np.flatnonzero(new)[1:], len(x))[np.cumsum(new) - 1]
        for gap in range(1, int((end - np.arange(len(x))).max())):
            i = np.flatnonzero(np.arange(len(x)) + gap < end)
            keys.append(mix(x[i] * PLACE[8] + x[i + gap] * PLACE[9] + salt[i]))
            owners.append(d[i])
    return np.concatenate(keys), np.concatenate(owners)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by token, in tables that hold each token's rows together."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]).select(columns)
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not rows.num_rows:
            continue
        token = rows["token"].to_numpy()
        cut = int(np.searchsorted(token, token[-1]))
        if cut:
            yield rows.slice(0, cut)
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings in; those of tokens with several classes out. Copies of a class are one."""
    last = None  # the row before, and whether it has gone out
    for batch in batches:
        token, n, cls = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if last is not None:
            token, n, cls = (np.concatenate([[v], c]) for v, c in zip(last, (token, n, cls), strict=False))
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        out = last is not None and last[3]
        token, n, cls = token[new], n[new], cls[new]
        keep = np.zeros(len(token), bool)
        same = token[1:] == token[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        ended = keep.copy()
        if out:
            keep[0] = False
        keep[-1] &= len(token) > 1 or not out
        last = (token[-1], n[-1], cls[-1], bool(ended[-1] or (out and len(token) == 1)))
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (token, n, cls)], ["token", "n", "cls"])


def _stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Each class with the smallest set of its list that it may be similar to: the first, or the first out of its reach."""
    hub = None  # token, n, cls
    for batch in batches:
        token, n, cls = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        a, b = [], []
        cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else []
        for x, y in zip(cuts, [*cuts[1:], len(token)], strict=False):
            while x < y:
                if hub is None or hub[0] != token[x] or 100 * hub[1] < percent * n[x]:
                    hub = (token[x], n[x], cls[x])
                    x += 1
                    continue
                z = x + int(np.searchsorted(n[x:y], 100 * hub[1] // percent, "right"))
                a.append(np.full(z - x, hub[2]))
                b.append(cls[x:z])
                x = z
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _apart(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches prove the sets not similar."""
    differ = np.bitwise_count(sa ^ sb).sum(-1).astype(np.int64)
    total = na + nb
    need = -(-percent * total // (100 + percent))  # least intersection
    return differ > total - 2 * need


class _List:
    """One posting list: sets that share a token, with their components' labels and sketches."""

    def __init__(self, n: np.ndarray, label: np.ndarray, sketch: np.ndarray, percent: int):
        self.n, self.label, self.sketch, self.percent = n, label, sketch, percent

    def near(self, i: int, other: np.ndarray) -> np.ndarray:
        """Those of other that may be similar to i."""
        fits = 100 * np.minimum(self.n[i], self.n[other]) >= self.percent * np.maximum(self.n[i], self.n[other])
        other = other[fits]
        return other[~_apart(self.sketch[i], self.sketch[other], self.n[i], self.n[other], self.percent)]

    def pairs(self, most: int | None) -> tuple[list, list] | None:
        """All pairs across labels that may be similar; None if there are more than ``most``."""
        _, group, size = np.unique(self.label, return_inverse=True, return_counts=True)
        done, a, b, total = np.zeros(len(self.n), bool), [], [], 0
        for g in np.argsort(size, kind="stable")[:-1].tolist():  # the smaller ones against all that is left
            mine = np.flatnonzero(group == g)
            done[mine] = True
            other = np.flatnonzero(~done)
            for i in mine.tolist():
                near = self.near(i, other)
                total += len(near)
                if most is not None and total > most:
                    return None
                a.append(np.full(len(near), i))
                b.append(near)
        return a, b

    def forest(self) -> tuple[list, list]:
        """A minimum spanning forest of these pairs by the sketches' differences; members of one component are joined already."""
        size, far = len(self.n), 1 << 30
        best, parent, open_ = np.full(size, far), np.full(size, -1), np.ones(size, bool)
        a, b, v = [], [], 0
        for _ in range(size):
            if best[open_].min() < far:
                v = int(np.where(open_, best, far).argmin())
                if best[v] > 0 and self.label[v] != self.label[parent[v]]:
                    a.append(np.array([v]))
                    b.append(np.array([parent[v]]))
            else:
                v = int(open_.argmax())
            open_[v] = False
            rest = np.flatnonzero(open_)
            if not len(rest):
                break
            gap = np.full(size, far)
            near = self.near(v, rest)
            gap[near] = 1 + np.bitwise_count(self.sketch[v] ^ self.sketch[near]).sum(-1).astype(np.int64)
            gap[rest[self.label[rest] == self.label[v]]] = 0
            less = gap < best
            best[less], parent[less] = gap[less], v
        return a, b


def _across(batches: Iterator[pa.RecordBatch], percent: int, everything: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of each list across components that the sketches don't prove apart.

    All of them if ``everything`` or if they are few for the list. Else a spanning forest, the likeliest first, and a row with the
    token, for another round when these have been verified.
    """
    for rows in _runs(batches, ["token", "n", "cls", "label", "sketch"]):
        token, n, cls, label = (rows[c].to_numpy() for c in ("token", "n", "cls", "label"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(token), -1)
        cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        a, b, again = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for x, y in zip(cuts, [*cuts[1:], len(token)], strict=True):
            if (label[x:y] == label[x]).all():
                continue
            own = _List(n[x:y], label[x:y], sketch[x:y], percent)
            found = own.pairs(None if everything else 2 * int(y - x))
            if found is None:
                found = own.forest()
                again.append(token[x])
            a += [cls[x + i] for i in found[0]]
            b += [cls[x + i] for i in found[1]]
        a, b, k = np.concatenate(a), np.concatenate(b), len(again)
        one, two, empty = np.minimum(a, b), np.maximum(a, b), np.full(k, -1)
        names = ["a", "b", "token"]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([one, empty])), pa.array(np.concatenate([two, empty])), pa.array(np.concatenate([np.zeros(len(a), np.int64), np.array(again, np.int64)]), pa.int64(), mask=np.concatenate([np.ones(len(a), bool), np.zeros(k, bool)]))], names)


def _with_classes(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """All columns, and the number of shingles and the class of the text."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            sets = Sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets.n, pa.int64()), pa.array(sets.cls)], [*batch.schema.names, "_n", "_cls"])


def _unproven(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, SKETCH // 64) for c in ("sa", "sb"))
        na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
        yield batch.select(["a", "b"]).filter(pa.array(~_apart(sa, sb, na, nb, percent), pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            sets = Sets(batch.column("text"), words)
            own = [sets.tokens[a:b].tobytes() for a, b in zip(sets.at, sets.at[1:], strict=False)]
            rows = pa.RecordBatch.from_arrays([pa.array(sets.cls), batch.column("cls"), pa.array(own, pa.binary())], ["found", "cls", "tokens"])
            yield rows.filter(pa.array(sets.cls == batch.column("cls").to_numpy(zero_copy_only=False))).select(["cls", "tokens"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()


class Join:
    """The steps over one table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT):
        self.words, self.percent = words, percent
        self.spark, self.n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
        self.docs = docs.select("doc_id", "text")
        self.bits = max(4, (4 * self.n - 1).bit_length())
        self.paths: list[str] = []
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        scanned = self.docs.mapInArrow(lambda b, k=self.bits: _classes(b, k, words), f"doc_id {kind}, n long, cls long, sketch binary, block int, packed binary")
        self.scanned = self.keep(scanned, "jaccard-sets")
        #: (doc_id, n, cls)
        self.rows = self.scanned.where("n is not null").select("doc_id", "n", "cls")
        classes = self.scanned.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"))
        self.classes = classes

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        self.paths.append(path)
        release(self.spark)
        return df

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent of the low shingles, at most FREQUENT, sorted, and their classes."""
        rows = self.scanned.where("block is not null").select("block", "packed").groupBy("block").applyInArrow(_frequent, "short long, level int")
        rows = self.keep(rows, "jaccard-frequent")
        least, total = 1 << 30, 0
        for r in rows.groupBy("level").count().orderBy(F.desc("level")).collect():
            total += r["count"]
            if total > FREQUENT:
                break
            least = r["level"]
        got = rows.where(F.col("level") >= least).toArrow()
        short, level = got["short"].to_numpy(), got["level"].to_numpy()
        by = np.argsort(short)
        return short[by], level[by].astype(np.int8)

    def postings(self) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(self.frequent())
        bits, words, percent = self.bits, self.words, self.percent
        rows = self.docs.mapInArrow(lambda b: _prefixes(b, shared, bits, words, percent), "token long, n long, cls long")
        rows = rows.repartition(self.n, "token").sortWithinPartitions("token", "n", "cls")
        return self.keep(rows.mapInArrow(lambda x: trimmed(_posted(x)), "token long, n long, cls long"), "jaccard-postings")

    def sorted_lists(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.n, "token").sortWithinPartitions("token", "n", "cls")

    def similar(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b), those whose sets are similar."""
        words, percent = self.words, self.percent
        of = lambda s: self.classes.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
        pairs = pairs.distinct().join(of("a"), "a").join(of("b"), "b").mapInArrow(lambda x: trimmed(_unproven(x, percent)), "a long, b long")
        pairs = self.keep(pairs, f"{name}-candidates")
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(self.classes.select("cls", "doc_id"), "cls")
        texts = self.docs.join(wanted, self.docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("text", "cls")
        # used twice below: one exchange by class, which both joins read
        sets = texts.mapInArrow(lambda x: _sets(x, words), "cls long, tokens binary").dropDuplicates(["cls"])
        joined = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
        return self.keep(joined.mapInArrow(lambda x: _verified(x, percent), "a long, b long"), f"{name}-links")

    def across(self, postings: DataFrame, labels: DataFrame, everything: bool) -> DataFrame:
        """(a, b, token) of the lists whose classes have several labels (cls, label; none: the class itself)."""
        percent = self.percent
        rows = postings.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        open_lists = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token")
        rows = rows.join(open_lists, "token", "left_semi").join(self.classes.select("cls", "sketch"), "cls")
        return self.sorted_lists(rows.select("token", "n", "cls", "label", "sketch")).mapInArrow(lambda x: trimmed(_across(x, percent, everything)), "a long, b long, token long")

    def done(self) -> None:
        for path in self.paths[1:]:
            drop_stored(self.spark, path)


def all_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every pair (a, b) of similar classes, and the membership (doc_id, n, cls)."""
    join = Join(docs, words, percent)
    postings = join.postings()
    none = join.spark.createDataFrame([], "cls long, label long")
    return join.similar(join.across(postings, none, True).select("a", "b"), "jaccard-all"), join.rows


def labelled(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, Join]:
    """(doc_id, n, cls, label) of each row: its class and what names the component."""
    join = Join(docs, words, percent)
    postings = join.postings()
    stars = join.sorted_lists(postings).mapInArrow(lambda x: trimmed(_stars(x, percent)), "a long, b long")
    links = join.similar(stars, "jaccard-1")
    labels, path = connected_components(links)
    join.paths.append(path)
    found = join.keep(join.across(postings, labels, False), "jaccard-across")
    links = links.union(join.similar(found.where("token is null").select("a", "b"), "jaccard-2"))
    labels, path = connected_components(links)
    again = found.where("token is not null").select("token").distinct()
    if not again.isEmpty():
        join.paths.append(path)
        rest = join.across(postings.join(again, "token", "left_semi"), labels, True).select("a", "b")
        links = links.union(join.similar(rest, "jaccard-3"))
        labels, _ = connected_components(links)
    return join.rows.join(labels, "cls", "left").select("doc_id", "n", "cls", F.coalesce("label", "cls").alias("label")), join


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    rows, join = labelled(docs, words, percent)
    least = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    join.done()
    return out


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of similar ones, the one with the smallest id, or one without an id where no other is.

    Documents without a word stay; of rows with equal id and text one stays, of equal texts without an id too, if they have words.
    """
    names = docs.columns
    docs = docs.toDF(*(c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(names)))
    rows, join = labelled(docs, words, percent)
    groups, _ = stored(rows, "jaccard-groups")
    join.done()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("best")
    chosen = groups.where("n > 0").groupBy("label").agg(best).select("best.doc_id", "best.cls")
    kept = chosen.select("doc_id").union(groups.where("n = 0").select("doc_id")).where("doc_id is not null").distinct()
    # ids that name one row decide by themselves; the other rows' classes are looked at
    several = groups.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id")
    if groups.where("doc_id is null").isEmpty() and several.isEmpty():
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).toDF(*names)
    out = docs.join(kept.join(several, "doc_id", "left_anti"), "doc_id", "left_semi").select(*docs.columns)
    unsure = docs.join(several, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    schema = StructType([*unsure.schema.fields, StructField("_n", LongType()), StructField("_cls", LongType())])
    unsure = unsure.mapInArrow(lambda b: _with_classes(b, words), schema)
    wordless = unsure.where("_n = 0")
    wordless = wordless.where("doc_id is null").union(wordless.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("cls").alias("_own"))
    found = unsure.where("_n > 0").join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_cls") == F.col("_own")), "left_semi").dropDuplicates(["doc_id", "_cls"])
    return out.union(wordless.select(*docs.columns)).union(found.select(*docs.columns)).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
