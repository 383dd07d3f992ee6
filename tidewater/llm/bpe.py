"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly if each neighbouring pair is
the encoding of its own bytes; so every prefix of a text has one encoding, which some shorter prefix's
encoding and one more token make up. The transducer reads bytes. An NFA state is a place where a token
may still be growing: a trie node, the token before it, and the tokens not yet written. A state of
the determinised machine is the set of these for one prefix; the tokens that all of them share are
written at once, the rest after a lookahead bounded by the longest token. States and moves are made
when first met and kept (up to a bound, then begun anew).

Pre-tokens repeat, so results are kept by pre-token and by run between single spaces, both bounded.

Cases: null text is empty and has no token; a very long text is one row like any other; repeated rows are
encoded each; extra columns are ignored; any text is valid input, and every byte has a token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm._common import slices, table, texts_of, tokenizer_path

KEPT_BYTES = 48 << 20  # of pre-tokens, and of runs, that a worker keeps
STATES = 400_000  # moves that a worker keeps


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """bytes of one pre-token -> token ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}
        self.next: dict[int, int] = {}  # node * 256 + byte -> node
        self.ends: list[int] = [-1]  # token that ends at a node
        self.grows: list[bool] = [False]
        for t, i in ranks.items():
            node = 0
            for b in t:
                to = self.next.get(node << 8 | b)
                if to is None:
                    to = self.next[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.grows.append(False)
                    self.grows[node] = True
                node = to
            self.ends[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [((0, -1, ()),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, bytes]] = {}

    def merged(self, raw: bytes) -> list[bytes]:
        """The definition: merge the neighbours of lowest rank, leftmost first, as long as any can be."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            x, y = self.token[a], self.token[b]
            if len(self.pairs) > 4 * STATES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return known

    def move(self, state: int, byte: int) -> tuple[int, bytes]:
        """Determinise one more move: the next state and what is written on the way."""
        live, whole = [], None
        for node, last, rest in self.states[state]:
            to = self.next.get(node << 8 | byte)
            if to is None:
                continue
            if self.grows[to]:
                live.append((to, last, rest))
            token = self.ends[to]
            if token >= 0 and whole is None and (last < 0 or self.fits(last, token)):
                whole = (0, token, (*rest, token))
        live.append(whole)
        shared = live[0][2]
        for _, _, rest in live:
            k = 0
            for x, y in zip(shared, rest, strict=False):
                if x != y:
                    break
                k += 1
            shared = shared[:k]
        new = tuple((node, last, rest[len(shared) :]) for node, last, rest in live)
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        found = self.moves[state << 8 | byte] = to, np.array(shared, "<u4").tobytes()
        return found

    def encode(self, raw: bytes) -> bytes:
        if len(self.moves) > STATES:
            self.clear()
        state, out, moves = 0, [], self.moves
        for byte in raw:
            step = moves.get(state << 8 | byte) or self.move(state, byte)
            state = step[0]
            if step[1]:
                out.append(step[1])
        # the item that covers the whole input ends it
        out.append(np.array(self.states[state][-1][2], "<u4").tobytes())
        return b"".join(out)


class _PreTokens(dict):
    def __init__(self, machine: Transducer):
        self.machine, self.held = machine, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.machine.encode(word.encode())
        if self.held < KEPT_BYTES:
            self[word] = ids
            self.held += 180 + 2 * len(word) + len(ids)
        return ids


class _Runs(dict):
    """What stands between two single spaces -> ids with the space before it; None if it isn't apart from its neighbours."""

    def __init__(self, split, words: _PreTokens):
        self.split, self.words, self.held = split, words, 0

    def __missing__(self, run: str) -> bytes | None:
        if not run or run[0].isspace() or run[-1].isspace():
            ids = None
        else:
            ids = b"".join(map(self.words.__getitem__, self.split(f" {run}")))
        if self.held < KEPT_BYTES:
            self[run] = ids
            self.held += 180 + 2 * len(run) + len(ids or b"")
        return ids


class Encoder:
    """Whole texts. A single space between others that are no white space always opens a pre-token, so runs between spaces are independent."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.words = _PreTokens(Transducer(ranks))
        self.runs = _Runs(self.split, self.words)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        if rest and first and not first[0].isspace() and not first[-1].isspace():
            try:
                return b"".join([*map(self.words.__getitem__, self.split(first)), *map(self.runs.__getitem__, rest)])
            except TypeError:  # a None: white space meets white space
                pass
        return b"".join(map(self.words.__getitem__, self.split(text)))


class Utf8Machine:
    """Incremental UTF-8: passes on bytes up to the last complete character and holds the rest back."""

    def __init__(self):
        self.held = b""

    def feed(self, raw: bytes) -> bytes:
        raw = self.held + raw
        for back in range(1, min(4, len(raw) + 1)):
            lead = raw[-back]
            if lead & 0xC0 == 0x80:
                continue  # in the middle of a character
            need = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
            if need > back:
                self.held = raw[-back:]
                return raw[:-back]
            break
        self.held = b""
        return raw

    def end(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


def decode(ids: bytes, tokens: dict[int, bytes], block: int = 8192) -> Iterator[bytes]:
    """Bytes of whole characters, block by block; bytes that make no character come out as they are."""
    machine, of = Utf8Machine(), tokens.__getitem__
    array = np.frombuffer(ids, "<u4")
    for k in range(0, len(array), block):
        yield machine.feed(b"".join(map(of, array[k : k + block].tolist())))
    yield machine.end()


_WORKER: dict = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _WORKER:
        _WORKER[path, pattern] = Encoder(read_ranks(path), pattern)
    return _WORKER[path, pattern]


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, pattern)
    tokens = encoder.words.machine.token
    for whole in batches:
        for batch in slices(whole, "text"):
            n, ids_sha, text_sha = [], [], []
            for text in texts_of(batch.column("text")):
                ids = encoder.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                back = hashlib.sha256()
                for piece in decode(ids, tokens):
                    back.update(piece)
                text_sha.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, pattern)
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            ids = [np.frombuffer(encoder.encode(t), "<u4").astype(np.int32) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    tokens = _encoder(path, pattern).words.machine.token
    for batch in batches:
        texts = [b"".join(decode(np.array(x or [], "<u4").tobytes(), tokens)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text)."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda b: _encoded(b, path, pattern), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); bytes that make no character become U+FFFD."""
    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(lambda b: _decoded(b, path, pattern), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode again, and return the digests of both."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda b: _digests(b, path, pattern), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
