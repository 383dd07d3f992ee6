"""Best-fit packing by sums of squares.

N(g) is the number of open sequences with g tokens left. A piece of s tokens goes where the sum of N(g)^2 over
all gaps becomes smallest, among the gaps g >= s (which turn into g - s); it opens a new sequence if none
is large enough. Ties go to the tightest gap. Pieces come largest first, so that small ones fill what is left.

Documents become pieces of at most ``CAPACITY`` tokens: only longer ones are cut, their first piece
takes the odd length and the others are full. Only lengths and digests leave the tokenizing tasks. Pieces are dealt
by hash into shards of about ``SHARD`` pieces, each packed by one task: memory is bounded and a
shard's unfilled last sequences are few beside those it fills.

Cases: null text is empty: one piece holding the end token alone; repeated rows are packed each (by
doc_id and a digest they may share a shard, never a place); extra columns are ignored; an empty table gives no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm._common import slices, stored, table, texts_of, tokenizer_path
from tidewater.llm.bpe import read_ranks

CAPACITY, END_ID, SPECIAL = 2048, 0, "<|endoftext|>"
SHARD = 25_000
KEPT_BYTES = 64 << 20  # of runs and their ids that a worker keeps


def sum_of_squares_pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to capacity)."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # N(g)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for at in order.tolist():
        s = int(sizes[at])
        if s == capacity:
            bins[at], made = made, made + 1
            continue
        own = count[s:]
        # change of the sum: gap g > s loses one of N(g) and gives one to N(g - s); g = s closes the bin
        change = np.where(own > 0, 2 * (count[: capacity + 1 - s] - own + 1), np.iinfo(np.int64).max)
        if own[0]:
            change[0] = 1 - 2 * own[0]
        k = int(change.argmin())
        if own[k]:
            gap = s + k
            where = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, where, made = capacity, made, made + 1
        bins[at], offsets[at] = where, capacity - gap
        if gap > s:
            count[gap - s] += 1
            stacks[gap - s].append(where)
    return bins, offsets


class _Runs(dict):
    """ids of a run and the space before it; None if the run isn't apart from its neighbours."""

    def __init__(self, encode):
        self.encode, self.held = encode, 0

    def __missing__(self, run: str) -> bytes | None:
        ids = None if not run or run[0].isspace() or run[-1].isspace() else np.array(self.encode(f" {run}"), "<u4").tobytes()
        if self.held < KEPT_BYTES:
            self[run] = ids
            self.held += 200 + 2 * len(run) + len(ids or b"")
        return ids


class Tokens:
    """ids of whole texts by the vocabulary of ``json``; ``ranks`` is the same vocabulary for the faster library."""

    def __init__(self, json: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json)
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={}).encode_ordinary
        self.runs = _Runs(self.encode)

    def of(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        if rest and first and not first[0].isspace() and not first[-1].isspace():
            try:
                return b"".join([np.array(self.encode(first), "<u4").tobytes(), *map(self.runs.__getitem__, rest)])
            except TypeError:  # a None: white space meets white space
                pass
        return np.array(self.encode(text), "<u4").tobytes()


_WORKER: dict = {}


def _pieces(batches: Iterator[pa.RecordBatch], paths: tuple[str, str, str], capacity: int) -> Iterator[pa.RecordBatch]:
    if paths not in _WORKER:
        _WORKER[paths] = Tokens(*paths)
    tokens, end = _WORKER[paths], np.array([END_ID], "<u4").tobytes()
    for whole in batches:
        for batch in slices(whole, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                ids = tokens.of(text) + end
                n = len(ids) // 4
                a, k = 0, 0
                while a < n:
                    b = min(n, a + ((n % capacity or capacity) if a == 0 else capacity))
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    a, k = b, k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def _packed(group: pa.Table, capacity: int) -> pa.Table:
    group = group.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
    bins, offsets = sum_of_squares_pack(group["length"].to_numpy(), capacity)
    shard = group["shard"][0].as_py()
    ids = pa.array(bins + (shard << 40), pa.int64())
    return group.drop_columns(["shard"]).append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))


def pack(docs: DataFrame, paths: tuple[str, str, str], capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of docs (doc_id, text)."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces, _ = stored(rows.mapInArrow(lambda b: _pieces(b, paths, capacity), columns), "pieces")
    shards = max(1, round(pieces.count() / shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(lambda t: _packed(t, capacity), f"{columns}, sequence_id long, offset long")


def paths() -> tuple[str, str, str]:
    import public_tokenizers

    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), paths())
