"""Removal of repeated passages: bucket-pointer refinement over suffixes, cut to windows of ``LENGTH`` bytes.

A suffix's bucket is refined from q-grams by bucket identifiers of later offsets, and each
refinement is used by the next: 8 raw bytes name a bucket; the identifiers at p and p + 8 name the one
of 16 bytes, those at p and p + 16 the one of 32, then 64, and those of 64 at p and p + 36 the window of 100.
Identifiers are 64-bit hashes, so that all tasks name buckets alike without a global sort; what is taken for equal agrees in
two of them.

Not every suffix is shuffled. A window is posted under the leftmost smallest of its 32-byte buckets; equal
windows agree in that. Neighbouring windows with the same one make a span (about 35 windows), the
unit that moves:

1. Scan: spans with bucket (32 bytes) and class (everything the span covers). Spans equal to an earlier one of
   the same slice are marked at once, so that large groups of copies shrink before the shuffle.
2. Sorted by bucket and class, all but a class's first span are repeats. Buckets left with several classes
   (edges of passages, edits in near copies) need their windows compared.
3. The text of those spans is fetched from the documents, and their windows are refined within the
   bucket. A bucket is dealt in parts of ``PART`` classes at most; where it has several, each part's first windows meet in one
   more shuffle by window.
4. Ranges are gathered by document, merged and cut out.

A document is known by (doc_id, hash of its text). Cases: a null text is empty; texts shorter than the window
stay whole; null ids come before all others; rows with equal id and text are one document and get the same
result; rows with equal id and other text are two, ordered by hash; very long texts are scanned in pieces of
``SLICE`` bytes that overlap; extra columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm._common import even_slices, mix, shuffle_partitions, slices, table, text_bytes

LENGTH, GRAM = 100, 32
SLICE = 2 << 20
PART = 20_000
FIRST = -(2**63)
SPAN = "h1 long, h2 long, k1 long, k2 long, at long, upto long"
FOUND = "k1 long, k2 long, ask boolean, x long, y long, part int"
RANGE = "route long, window long, k1 long, k2 long, x long, y long"


def refine(ids: np.ndarray, gap: int) -> np.ndarray:
    """Identifiers of longer suffixes from those at p and at p + gap."""
    later = ids[gap:]
    h = ids[: len(later)] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += later * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def identifiers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the 32 bytes and of the 100 bytes from each position on."""
    n = len(raw)
    eight = np.empty(n - 7, np.uint64)
    for k in range(8):
        m = (n - k) // 8
        eight[k::8] = raw[k : k + 8 * m].view("<u8")
    gram = refine(refine(eight, 8), 16)
    return gram, refine(refine(gram, 32), LENGTH - 64)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of each ``width`` neighbours."""
    least, at, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        gap = min(have, width - have)
        n = len(least) - gap
        less = least[gap:] < least[:n]
        at = np.where(less, at[gap:], at[:n])
        least = np.minimum(least[gap:], least[:n])
        have += gap
    return at


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(document, first and last window, anchor, bucket, class) of each span; at: where documents begin."""
    if len(raw) < LENGTH:
        return None
    gram, window = identifiers(raw)
    n = len(window)
    anchor = leftmost_least((gram >> np.uint64(32)).astype(np.uint32), LENGTH - GRAM + 1)[:n]
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    whole = np.arange(LENGTH, n + LENGTH) <= at[1:][doc[:n]]
    same = np.zeros(n + 1, bool)
    same[1:n] = whole[1:] & whole[:-1] & (anchor[1:] == anchor[:-1])
    first, last = np.flatnonzero(whole & ~same[:n]), np.flatnonzero(whole & ~same[1:])
    if not len(first):
        return None
    a = anchor[first]
    shape = ((a - first).astype(np.uint64) << np.uint64(8)) | (last - first).astype(np.uint64)
    return doc[first], first, last, a, gram[a], mix(window[first] + mix(window[last] + shape))


def merged(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the ranges [x, y) of each owner; they come sorted by owner and x."""
    if not len(x):
        return x, y, own
    big = np.int64(1) << 40
    reach = np.maximum.accumulate(y + own * big)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] + own[1:] * big > reach[:-1]
    start = np.flatnonzero(new)
    return x[start], np.append(reach[start[1:] - 1], reach[-1]) - own[start] * big, own[start]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in even_slices(batches, "text", SLICE):
        k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
        raw, at = text_bytes(batch.column("text"))
        pieces = [(raw, at, 0)]
        if batch.num_rows == 1 and len(raw) > SLICE:
            pieces = [(part := raw[a : a + SLICE + LENGTH - 1], np.array([0, len(part)]), a) for a in range(0, len(raw), SLICE)]
        order = np.lexsort((k2, k1))
        opens = np.ones(len(order), bool)  # equal rows are one document: they share a rank
        opens[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(opens) - 1
        order = order[opens]
        for part, begins, shift in pieces:
            found = spans(part, begins)
            if found is None:
                continue
            doc, first, last, anchor, h1, h2 = found
            s = first - begins[doc] + shift
            place = rank[doc] << np.int64(40) | s
            by = np.lexsort((place, h2, h1))
            again, twice = np.zeros(len(by), bool), np.zeros(len(by), bool)
            again[1:] = (h1[by][1:] == h1[by][:-1]) & (h2[by][1:] == h2[by][:-1])
            twice[1:] = again[1:] & (place[by][1:] == place[by][:-1])  # the same span, of an equal row
            keep, gone = by[~again], by[again & ~twice]
            gone = gone[np.argsort(place[gone], kind="stable")]
            x, y, own = merged(s[gone], s[gone] + (last - first)[gone] + LENGTH, rank[doc[gone]])
            own = order[own]
            packed = s << np.int64(16) | (last - first) << np.int64(8) | (anchor - first)
            route = mix(k1[own].astype(np.uint64) + mix(k2[own].astype(np.uint64)))
            columns = (
                np.concatenate([h1[keep], route]).view(np.int64), np.concatenate([h2[keep], np.zeros(len(own), np.uint64)]).view(np.int64),
                np.concatenate([k1[doc[keep]], k1[own]]), np.concatenate([k2[doc[keep]], k2[own]]),
                np.concatenate([packed[keep], x]), np.concatenate([np.zeros(len(keep), np.int64), y]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h1", "h2", "k1", "k2", "at", "upto"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans in; repeats as ranges out, and the first spans of buckets with several classes as questions."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    held = None  # the last class's first span: h1, h2, k1, k2, at, its number in the bucket, whether asked

    def rows(k1, k2, ask, x, y, part) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(np.full(len(k1), ask)), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(part, pa.int32())], names)

    for batch in batches:
        h1, h2, k1, k2, at, upto = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        done = upto > 0
        if done.any():
            yield rows(k1[done], k2[done], False, at[done], upto[done], np.zeros(done.sum(), np.int32))
            h1, h2, k1, k2, at = (c[~done] for c in (h1, h2, k1, k2, at))
        if not len(h1):
            continue
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = held is None or (h1[0], h2[0]) != held[:2]
        # an equal row's span is the class's first one itself and no repeat of it
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        own = (k1 == k1[lead]) & (k2 == k2[lead]) & (at == at[lead])
        if held is not None:
            own = np.where(lead < 0, (k1 == held[2]) & (k2 == held[3]) & (at == held[4]), own)
        again = ~new & ~own
        s = at[again] >> 16
        yield rows(k1[again], k2[again], False, s, s + ((at[again] >> 8) & 255) + LENGTH, np.zeros(again.sum(), np.int32))
        first = np.flatnonzero(new)
        if not len(first):
            continue
        f1, f2, fk1, fk2, fat = (c[first] for c in (h1, h2, k1, k2, at))
        number = np.zeros(len(first), np.int64)
        if held is not None:
            f1, f2, fk1, fk2, fat = (np.concatenate([[v], c]) for v, c in zip(held[:5], (f1, f2, fk1, fk2, fat), strict=True))
            number = np.zeros(len(f1), np.int64)
        opens = np.ones(len(f1), bool)
        opens[1:] = f1[1:] != f1[:-1]
        index = np.arange(len(f1))
        number = index - np.maximum.accumulate(np.where(opens, index, 0))
        if held is not None:
            number[: (np.flatnonzero(opens[1:])[0] + 1) if opens[1:].any() else len(f1)] += held[5]
        several = ~opens
        several[:-1] |= ~opens[1:]
        if held is not None and held[5] > 0:
            several[0] = True
        out = np.flatnonzero(several[:-1])
        yield rows(fk1[out], fk2[out], True, fat[out], f1[out], (number[out] // PART).astype(np.int32))
        held = (f1[-1], f2[-1], fk1[-1], fk2[-1], fat[-1], number[-1])
    if held is not None and held[5] > 0:
        yield rows(*([v] for v in held[2:4]), True, [held[4]], [held[0]], [held[5] // PART])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the spans in question."""
    for whole_batch in batches:
        for batch in slices(whole_batch, "text"):
            h1, part, k1, k2, at, raw = [], [], [], [], [], []
            for own1, own2, text, asked in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "asked")), strict=True):
                whole = (text or "").encode()
                for q in asked:
                    s, more = q["x"] >> 16, (q["x"] >> 8) & 255
                    h1.append(q["y"])
                    part.append(q["part"])
                    k1.append(own1)
                    k2.append(own2)
                    at.append(q["x"])
                    raw.append(whole[s : s + more + LENGTH])
                if len(raw) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(part, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(at, pa.int64()), pa.array(raw, pa.binary())], ["h1", "part", "k1", "k2", "at", "raw"])
                    h1, part, k1, k2, at, raw = [], [], [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(part, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(at, pa.int64()), pa.array(raw, pa.binary())], ["h1", "part", "k1", "k2", "at", "raw"])


def _compared_windows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole parts of buckets, sorted by bucket, part, document and place: their repeated windows as ranges."""
    h1, part, k1, k2, at = (rows[c].to_numpy() for c in ("h1", "part", "k1", "k2", "at"))
    raw, begins = text_bytes(rows["raw"].combine_chunks())
    _, window = identifiers(raw)
    n, lead, s = ((at >> 8) & 255) + 1, at & 255, at >> 16
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    ids = window[begins[row] + j]
    shape = mix(h1.view(np.uint64)[row] + mix((lead[row] - j).astype(np.uint64)))
    bucket = mix(shape + part[row].astype(np.uint64))
    key = mix(ids + bucket)
    by = np.argsort(key, kind="stable")
    again = np.zeros(len(by), bool)
    again[by[1:]] = key[by[1:]] == key[by[:-1]]
    # neighbouring repeats of a row make one range
    opens = again.copy()
    opens[1:] &= ~(again[:-1] & (row[1:] == row[:-1]))
    ends = again.copy()
    ends[:-1] &= ~(again[1:] & (row[1:] == row[:-1]))
    a, b = np.flatnonzero(opens), np.flatnonzero(ends)
    own = row[a]
    route = mix(k1[own].astype(np.uint64) + mix(k2[own].astype(np.uint64))).view(np.int64)
    out = [route, np.zeros(len(a), np.int64), k1[own], k2[own], s[own] + j[a], s[own] + j[b] + LENGTH]
    # a bucket of several parts: the first windows of each meet again
    edges = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (part[1:] != part[:-1])]))
    size = np.diff(np.append(edges, len(h1)))
    split = np.repeat((size >= PART) | (part[edges] > 0), size)
    w = np.flatnonzero(split[row] & ~again)
    if len(w):
        own = row[w]
        more = [mix(ids[w] + shape[w]).view(np.int64), (mix(shape[w]) | np.uint64(1)).view(np.int64), k1[own], k2[own], s[own] + j[w], s[own] + j[w] + LENGTH]
        out = [np.concatenate(c) for c in zip(out, more, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["route", "window", "k1", "k2", "x", "y"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not rows.num_rows:
            continue
        h1, part = rows["h1"].to_numpy(), rows["part"].to_numpy()
        other = np.flatnonzero((h1 != h1[-1]) | (part != part[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last part may go on in the next batch
        if cut:
            yield from _compared_windows(rows.slice(0, cut))
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield from _compared_windows(rest)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges pass; of the windows of divided buckets, sorted, all but the first of each become ranges."""
    last = None
    for batch in batches:
        route, window, k1, k2, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(route):
            continue
        same = np.zeros(len(route), bool)
        same[1:] = (route[1:] == route[:-1]) & (window[1:] == window[:-1])
        same[0] = last == (route[0], window[0])
        last = (route[-1], window[-1])
        keep = (window == 0) | same
        yield pa.RecordBatch.from_arrays([pa.array(c[keep], pa.int64()) for c in (k1, k2, x, y)], ["k1", "k2", "x", "y"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("k1", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))).withColumn("k2", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0x7FFFFFFF))


def repeats(docs: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """docs (k1, k2, text, others) with ``ranges``: what to cut out, as a list of (x, y); null for none."""
    n = shuffle_partitions(docs.sparkSession)
    texts = docs.select("k1", "k2", "text")
    scanned = texts.mapInArrow(_scanned, SPAN).repartition(n, "h1").sortWithinPartitions("h1", "h2", "k1", "k2", "at")
    found = scanned.mapInArrow(_classes, FOUND).groupBy("k1", "k2").agg(
        # a set: equal rows have the same ranges
        F.collect_set(F.when(~F.col("ask"), F.struct("x", "y"))).alias("known"), F.collect_list(F.when(F.col("ask"), F.struct("x", "y", "part"))).alias("asked")
    )
    questions = docs.join(found.where(F.size("asked") > 0).select("k1", "k2", "asked"), ["k1", "k2"]).select("k1", "k2", "text", "asked").dropDuplicates(["k1", "k2"])
    fetched = questions.mapInArrow(_fetched, "h1 long, part int, k1 long, k2 long, at long, raw binary").repartition(n, "h1", "part").sortWithinPartitions("h1", "part", "k1", "k2", "at")
    answers = fetched.mapInArrow(_compared, RANGE).repartition(n, "route", "window").sortWithinPartitions("route", "window", "k1", "k2", "x")
    answers = answers.mapInArrow(_met, "k1 long, k2 long, x long, y long").groupBy("k1", "k2").agg(F.collect_list(F.struct("x", "y")).alias("more"))
    none = F.array().cast("array<struct<x:bigint,y:bigint>>")
    cut = docs.join(found.select("k1", "k2", "known"), ["k1", "k2"], "left").join(answers, ["k1", "k2"], "left")
    return cut.select("k1", "k2", "text", *others, F.concat(F.coalesce("known", none), F.coalesce("more", none)).alias("ranges"))


def kept_bytes(raw: bytes, ranges: list[dict]) -> tuple[bytes, int]:
    """What is left, and the number of maximal runs cut out."""
    out, upto, runs = [], 0, 0
    end = -1
    for r in sorted((r["x"], r["y"]) for r in ranges):
        if r[0] > end:
            out.append(raw[upto : r[0]])
            runs += 1
        end = max(end, r[1])
        upto = end
    out.append(raw[upto:])
    return b"".join(out), runs


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole_batch in batches:
        for batch in slices(whole_batch, "text"):
            size, gone, runs, sha = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                raw = (text or "").encode()
                left, n = kept_bytes(raw, ranges)
                size.append(len(raw))
                gone.append(len(raw) - len(left))
                runs.append(n)
                sha.append(hashlib.sha256(left).hexdigest())
            ids = pa.array([None if k == FIRST else k for k in batch.column("k1").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (size, gone, runs)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut_texts(batches: Iterator[pa.RecordBatch], size: str | None) -> Iterator[pa.RecordBatch]:
    """size: the column that counts a text's characters."""
    for whole_batch in batches:
        for batch in slices(whole_batch, "text"):
            texts, whole = [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                whole.append(not ranges)
                texts.append(text if not ranges else kept_bytes((text or "").encode(), ranges)[0].decode("utf-8", "ignore"))
            names = [c for c in batch.schema.names if c not in ("k1", "k2", "ranges")]
            out = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if size is not None:
                out[size] = pa.array([n if w else len(t) for n, w, t in zip(out[size].to_pylist(), whole, texts, strict=True)], out[size].type)
            rows = pa.RecordBatch.from_arrays(list(out.values()), list(out))
            yield rows.filter(pa.array([w or bool(t) for w, t in zip(whole, texts, strict=True)], pa.bool_()))


def removal_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    rows = keyed(docs.select("doc_id", "text")).select("k1", "k2", "text")
    return repeats(rows).mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs without the repeated passages; a character cut in two goes, and so does a row of which nothing is left.

    Columns stay, whatever their names (``doc_id``, a whole number, and ``text`` have to be there); ``n_chars`` follows the text where there is one.
    """
    inner = {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*inner.values())
    own = tuple(c for c in plain.columns if c != "text")
    size = inner.get("n_chars")
    cut = repeats(keyed(plain), own).mapInArrow(lambda b: _cut_texts(b, size), plain.select("text", *own).schema)
    return cut.select(*plain.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))
