"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-tokens.

Texts are cut at single spaces (no token of the vocabulary holds one; a vocabulary where one does is refused). For each block of documents
the pre-tokens are dictionary-encoded: every distinct one is counted once by the tokenizer (and kept
for later blocks, up to a bound), the counts are joined to the documents' codes by position, and
summed over each document's run of codes. No token ids of a document are ever made.

The join stays inside a task: document x pre-token pairs outnumber the documents by hundreds, and a
shuffle of them would cost more than all the counting.

Cases: null text is empty: 0 bytes, 0 tokens; special strings inside texts count as the tokenizer's default has it; a
very long text is one row like any other; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm._common import slices, table, tokenizer_path

KEPT_BYTES = 64 << 20  # of pre-tokens that a worker keeps
LIMIT = 2048
_WORKER: dict = {}


class PieceCounts:
    """Pieces of pre-tokens by the library that reads ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[str, int] = {}
        self.held = 0
        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.count = lambda texts: list(map(len, model.encode_batch_fast(texts, add_special_tokens=False)))

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        out = list(map(known.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        for i, n in zip(missing, self.count([words[i] for i in missing]) if missing else (), strict=True):
            out[i] = n
            if self.held < KEPT_BYTES:
                known[words[i]] = n
                self.held += 150 + 2 * len(words[i])
        return np.array(out, np.int64)


def per_document(texts: pa.Array, counter: PieceCounts) -> np.ndarray:
    """Tokens of each text."""
    runs = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
    at = runs.offsets.to_numpy()
    coded = runs.values.slice(int(at[0]), int(at[-1] - at[0])).dictionary_encode()
    counts = counter.of(coded.dictionary.to_pylist())
    total = np.concatenate([[0], np.cumsum(counts[coded.indices.to_numpy(zero_copy_only=False)])]) if len(coded) else np.zeros(1, np.int64)
    return np.diff(total[at - at[0]])


def _counted(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    if path not in _WORKER:
        _WORKER[path] = PieceCounts(path)
    for whole in batches:
        for batch in slices(whole, "text"):
            tokens = per_document(batch.column("text"), _WORKER[path])
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens, pa.int64()), pa.array(tokens > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def check_vocabulary(path: str) -> None:
    """Raise ValueError unless spaces are dropped and what they part is tokenized apart."""
    if not path.endswith(".json"):
        raise ValueError(f"{path}: pieces of this kind of vocabulary hold spaces")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    ids = lambda text: model.encode(text, add_special_tokens=False).ids
    probe = "The words of a text, 12 of them ."
    if ids(" ") or ids(probe) != [i for w in probe.split(" ") for i in ids(w)]:
        raise ValueError(f"{path}: tokens hold spaces, so texts can't be cut there")


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of docs (doc_id, text), for a vocabulary whose tokens never hold a space.

    That is so for word BPE with white space dropped, the kind registered here. Vocabularies with tokens that hold a space or its sign
    (byte-level, or pieces that join words) would be counted wrongly and raise ValueError.
    """
    check_vocabulary(path)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda b: _counted(b, path, limit), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
