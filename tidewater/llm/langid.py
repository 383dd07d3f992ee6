"""Language identification: nearest centroid over normalised TF-IDF vectors of byte n-grams.

Features: lower-cased UTF-8 text with ASCII digits and signs as one space, n-grams of 1 to 3 bytes hashed to ``DIM`` buckets, square-root term
frequency times inverse document frequency, unit length. Each language has up to ``CENTROIDS`` centroids (spherical
k-means). A text goes to the language of its most similar centroid by cosine; one whose similarity
is below a bound learned from the training texts is rejected.

The classifier is fitted on a bounded sample: about ``SAMPLE`` labelled rows in all and at most ``PER_LANG`` of a language, chosen by a hash of id and text among
all of them, and one row at least of every language, however many there are; prediction covers all rows and whole texts. The model is 16 KB for each centroid.

Cases: null text, or text without a letter, is ``und`` with score 0, and rejected; a null id is never
used for training and is not held out; a null language is never used for training; without any
labelled row every text is ``und``; ties go to the language first in order; repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm._common import slices, table, text_bytes

DIM, ORDERS, CENTROIDS = 4096, (1, 2, 3), 4
PER_LANG, SAMPLE = 400, 8000
FULL = 1500  # n-grams from which the bound for rejection holds in full
UND = "und"
#: ASCII letters and all bytes of other characters stay; the rest separates words.
LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts, a row for each text."""
    raw, at = text_bytes(pa.array([t.lower() for t in texts], pa.large_string()))
    n = len(texts)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    raw = LETTERS[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32) | (doc[1:] != doc[:-1])
    raw, doc = raw[keep], doc[keep]
    out = np.zeros(n * DIM, np.int64)
    x = raw.astype(np.uint32)
    for g in ORDERS:
        if len(x) < g:
            continue
        h = x[: len(x) - g + 1].copy()
        for k in range(1, g):
            h = (h << np.uint32(8)) | x[k : len(x) - g + 1 + k]
        bucket = ((h + np.uint32(g * 0x1000193)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
        first = doc[: len(h)]
        whole = first == doc[g - 1 :]  # not across two texts
        out += np.bincount(first[whole].astype(np.int64) * DIM + bucket[whole], minlength=n * DIM)
    return out.reshape(n, DIM)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(count).astype(np.float32) * idf
    length = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.maximum(length, 1e-12)[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            found = counts([t or "" for t in batch.column("text").to_pylist()])
            packed = [np.vstack([at := np.flatnonzero(row), row[at]]).astype(np.uint32).tobytes() for row in found]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("pick"), pa.array(packed, pa.binary())], ["lang", "pick", "packed"])


def _centroids(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean's nearest row, the next ones the least alike."""
    at = [int(np.argmax(v @ v.mean(0)))]
    while len(at) < min(k, len(v)):
        at.append(int(np.argmin((v @ v[at].T).max(1))))
    c = v[at]
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
    return c.astype(np.float32)


def fit(docs: DataFrame, learn: Column, per_lang: int = PER_LANG, sample: int = SAMPLE) -> dict:
    """Centroids from the rows of docs (doc_id, text, lang) where ``learn`` holds."""
    rows = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("pick", F.xxhash64("doc_id", "text"))
    sizes = rows.groupBy("lang").agg(F.count("*"), F.min("pick")).collect()
    if not sizes:
        return {"langs": [], "centroids": np.zeros((0, DIM), np.float32), "owner": np.zeros(0, np.int64), "idf": np.ones(DIM, np.float32), "least": np.zeros(0)}
    each = max(1, min(per_lang, sample // len(sizes)))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 1.25 * each / n), least) for lang, n, least in sizes], "lang string, share double, least long")
    chosen = rows.join(F.broadcast(shares), "lang").where((F.pmod("pick", F.lit(1_000_000)) < F.col("share") * 1_000_000) | (F.col("pick") == F.col("least")))
    chosen = chosen.select("lang", "pick", "text").dropDuplicates(["lang", "pick"])  # repeated rows teach once
    got = chosen.mapInArrow(_sparse, "lang string, pick long, packed binary").collect()
    langs, count, taken = sorted(r[0] for r in sizes), [], []
    seen, number = dict.fromkeys(langs, 0), {lang: j for j, lang in enumerate(langs)}
    for r in sorted(got, key=lambda r: (r["lang"], r["pick"], r["packed"])):
        if seen[r["lang"]] < each:
            seen[r["lang"]] += 1
            at, n = np.frombuffer(r["packed"], np.uint32).reshape(2, -1)
            row = np.zeros(DIM, np.int32)
            row[at] = n
            count.append(row)
            taken.append(number[r["lang"]])
    count, taken = np.stack(count), np.array(taken)
    idf = (np.log((1 + len(count)) / (1 + (count > 0).sum(0))) + 1).astype(np.float32)
    v = vectors(count, idf)
    parts, owner, least = [], [], []
    for j in range(len(langs)):
        own = v[taken == j]
        c = _centroids(own, CENTROIDS)
        parts.append(c)
        owner += [j] * len(c)
        least += [0.5 * float(np.quantile((own @ c.T).max(1), 0.01))] * len(c)
    return {"langs": langs, "centroids": np.concatenate(parts), "owner": np.array(owner), "idf": idf, "least": np.array(least)}


def predict(texts: list[str | None], model: dict) -> tuple[list[str], list[float], list[bool]]:
    langs, scores, rejected = [], [], []
    usable = [has_letter(t) for t in texts]
    count = counts([t or "" for t in texts])
    ease = np.minimum(1, np.sqrt(count.sum(1) / FULL))  # short texts are less like any centroid
    sim = vectors(count, model["idf"]) @ model["centroids"].T
    for row, ok, few in zip(sim, usable, ease, strict=True):
        if not ok or not len(row):
            langs.append(UND)
            scores.append(0.0)
            rejected.append(True)
            continue
        best = int(row.argmax())
        langs.append(model["langs"][model["owner"][best]])
        scores.append(round(min(1.0, max(0.0, float(row[best]))), 5))
        rejected.append(bool(row[best] < few * model["least"][best]))
    return langs, scores, rejected


def _predicted(batches: Iterator[pa.RecordBatch], shared, keep: bool) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for whole in batches:
        for part in slices(whole, "text", 2 << 20):
            for k in range(0, part.num_rows, 256):
                batch = part.slice(k, 256)
                langs, scores, rejected = predict(batch.column("text").to_pylist(), model)
                if keep:
                    yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row. The model is a few hundred KB for each language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lambda b: _predicted(b, shared, False), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda b: _predicted(b, shared, True), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs, ~held_out(F.col("doc_id"))))
