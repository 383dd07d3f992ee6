"""Quality rules: compression bands.

zstandard at a fixed level gives two kinds of ratio (bytes before / after): one of the whole document,
one of each fixed chunk. A document outside the band of its length class, or with too many chunks
outside the band for chunks, is repetitive or incompressible and is rejected. Plain counts on words,
symbols, lines and three-word windows come beside it (``base_*``).

Cases: a null or empty text has zero counts and is rejected by the base rule; a very long text is
compressed whole; repeated rows are judged each; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm._common import slices, table, texts_of

LEVEL = 3
#: Bytes up to which a band holds, least and greatest ratio. Short texts compress less. On sf0.1, prose labelled good has ratios (least, greatest) of
#: 1.21, 1.72 up to 400 bytes, 1.41, 1.90 up to 800, 1.61, 2.07 up to 1600, 1.84, 2.32 up to 6400, 2.18, 2.44 up to 25,600 and 2.40, 2.48 beyond; random words of
#: letters and digits at most 1.14, 1.27, 1.33, 1.38, 1.39 and 1.39. The least ratio lies between the two, with more room on the side of prose, the greatest
#: well over prose. Up to 200 bytes noise (0.90 to 1.05) and prose (0.25 to 1.74) overlap, so there is no least ratio.
BANDS = ((200, 0.0, 2.25), (400, 1.18, 2.5), (800, 1.33, 2.5), (1600, 1.4, 2.75), (6400, 1.5, 3.0), (25_600, 1.55, 3.5), (float("inf"), 1.55, 4.5))
#: Chunks of prose have ratios of 1.87 to 2.44 on sf0.01, chunks of random words of letters and digits 1.34 to 1.36. A text up to one chunk is judged whole.
CHUNK, CHUNK_BAND, BAD_CHUNKS = 2048, (1.5, 5.0), 0.25
WHITE = dict.fromkeys(b" \t\n\v\f\r")
SYMBOLS = b"#*$%&|<>"
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunk_share double, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    once: dict = {}
    ids = np.fromiter((once.setdefault(w, len(once)) for w in windows), np.int64, len(windows))
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum())


def repeated_lines(raw: bytes) -> int:
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def ratios(raw: bytes, press: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole, and the share of chunks outside the chunks' band; what is left at the end is judged in the last ``CHUNK`` bytes."""
    if not raw:
        return 0.0, 0.0
    whole = len(raw) / len(press.compress(raw))
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw) - CHUNK + 1, CHUNK)]
    if len(raw) > CHUNK and len(raw) % CHUNK:
        chunks.append(raw[-CHUNK:])
    bad = sum(not CHUNK_BAND[0] <= len(c) / len(press.compress(c)) <= CHUNK_BAND[1] for c in chunks)
    return whole, bad / len(chunks) if chunks else 0.0


def in_band(size: int, ratio: float, bad_share: float) -> bool:
    least, most = next((a, b) for upto, a, b in BANDS if size <= upto)
    return least <= ratio <= most and bad_share <= BAD_CHUNKS


def measure(text: str, press: zstandard.ZstdCompressor) -> tuple:
    raw = text.encode()
    words = raw.split()  # on bytes: exactly the six ASCII white spaces
    blank = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    again = repeated_words(words)
    failed = len(words) < 50 or 100 * again > 50 * len(words)
    ratio, bad = ratios(raw, press)
    return len(words), len(text) - blank, symbols, repeated_lines(raw), again, failed, round(ratio, 6), round(bad, 6), not failed and in_band(len(raw), ratio, bad)


def _measured(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in COLUMNS.split(", ")]
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = [measure(t, press) for t in texts_of(batch.column("text"))]
            if keep:
                yield batch.filter(pa.array([r[-1] for r in rows], pa.bool_()))
                continue
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the counts, the ratios and ``kept``."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = rows.mapInArrow(lambda b: _measured(b, False), f"id {rows.schema['id'].dataType.simpleString()}, {COLUMNS}")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns (``text`` is judged)."""
    return docs.mapInArrow(lambda b: _measured(b, True), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))
