"""Kernels without Spark: codes, packing, quality, hashing, contexts."""

import base64
import math
import random
import string
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from tidewater.llm import ann, bpe, context_mixing, jaccard_join, langid, packing, quality, suffix_dedup, token_counts
from tidewater.llm._common import slices, text_bytes

PATH = public_tokenizers.path
TEXTS = ["", " ", "Hello, world", "a  b\n\n c ", "don't we'll   stop\t\tit's", "naïve café 有害事象 😀😀", "x" * 5000, "ab" * 900, "  lead", "trail  ", "\u00a0nb\u2003sp", "<|endoftext|>", "a <|endoftext|> b", "12 345 6789", "é\u0301 ẞ İ Σς ΑΣ", "\x1c\x1d odd \x85 line", "tab\tand\nnew", "!!! ??? ###", "<|startoftext|>x"]
random_text = st.text(st.sampled_from("ab cdeE. ,'st\n\té世😀0 9"), max_size=60) | st.text(max_size=40)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(PATH("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH("byte_bpe_50k.tiktoken")), special_tokens={})


@settings(max_examples=500, deadline=None)
@given(text=random_text)
def test_bpe_is_the_librarys(encoder, library, text):
    ids = encoder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert b"".join(bpe.decode(ids, encoder.words.machine.token, 3)) == text.encode()


def test_bpe_on_odd_texts(encoder, library, monkeypatch):
    for text in TEXTS:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 500)
    small = bpe.Encoder(encoder.words.machine.ranks, public_tokenizers.PATTERN)
    for text in TEXTS * 2:
        assert small.encode(text) == encoder.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 5))
def test_utf8_machine_holds_back_only_unfinished_characters(raw, step):
    machine = bpe.Utf8Machine()
    out = [machine.feed(raw[i : i + step]) for i in range(0, len(raw), step)]
    assert b"".join(out) + machine.end() == raw


@settings(max_examples=200, deadline=None)
@given(random_text, st.integers(1, 5))
def test_utf8_machine_gives_whole_characters(text, step):
    machine, raw = bpe.Utf8Machine(), text.encode("utf-8", "ignore")
    assert "".join(machine.feed(raw[i : i + step]).decode() for i in range(0, len(raw), step)) + machine.end().decode() == raw.decode()


@settings(max_examples=200, deadline=None)
@given(st.lists(random_text, min_size=1, max_size=5))
def test_token_counts_are_the_librarys(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH("word_bpe_49k.json"))
    got = token_counts.per_document(pa.array(texts), token_counts.PieceCounts(PATH("word_bpe_49k.json")))
    assert got.tolist() == [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_on_odd_texts():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH("word_bpe_49k.json"))
    counter = token_counts.PieceCounts(PATH("word_bpe_49k.json"))
    for _ in range(2):
        got = token_counts.per_document(pa.array([*TEXTS, None], pa.string()), counter)
        assert got.tolist() == [len(model.encode(t, add_special_tokens=False).ids) for t in [*TEXTS, ""]]
    assert token_counts.per_document(pa.array([], pa.string()), counter).tolist() == []


def test_packing_ids_are_the_librarys():
    from tokenizers import Tokenizer

    exact, tokens = Tokenizer.from_file(packing.paths()[0]), packing.Tokens(*packing.paths())
    for text in TEXTS:
        assert np.frombuffer(tokens.of(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_packing_is_valid(sizes):
    bins, offsets = packing.sum_of_squares_pack(np.array(sizes, np.int64), 50)
    for b in set(bins.tolist()):
        own = sorted((o, s) for o, s, x in zip(offsets.tolist(), sizes, bins.tolist(), strict=True) if x == b)
        at = 0
        for o, s in own:
            assert o == at
            at += s
        assert at <= 50


def test_packing_places_where_squares_are_least():
    """Against the definition, step by step."""
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 20) for _ in range(80)), reverse=True)
    bins, _ = packing.sum_of_squares_pack(np.array(sizes), 20)
    gaps: dict[int, int] = {}
    for s, b in zip(sizes, bins.tolist(), strict=True):
        def cost(g, s=s):
            left = sorted([*gaps.values(), g - s]) if g == 20 else sorted([*list(gaps.values()), g - s])
            if g in gaps.values():
                left.remove(g)
            return sum(left.count(x) ** 2 for x in set(left) if x)
        open_gaps = {g for g in gaps.values() if g >= s}
        if b in gaps:
            assert gaps[b] >= s and cost(gaps[b]) == min(map(cost, open_gaps))
            gaps[b] -= s
        else:
            assert not open_gaps or s == 20
            gaps[b] = 20 - s
        gaps = {k: g for k, g in gaps.items() if g}


def test_packing_reaches_the_bound_on_mixed_sizes():
    sizes = np.random.default_rng(1).integers(1, 2048, 4000)
    bins, _ = packing.sum_of_squares_pack(sizes, 2048)
    assert bins.max() + 1 <= 1.01 * sizes.sum() / 2048 + 2


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#é\u00a0"), max_size=80))
def test_quality_counts(text):
    import zstandard

    assert quality.measure(text, zstandard.ZstdCompressor(level=3))[:6] == brute_quality(text)


def test_compression_bands():
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = " ".join(rng.choice(words) for _ in range(1500))
    noise = base64.b64encode(rng.randbytes(9000)).decode()
    noise = " ".join(noise[i : i + 12] for i in range(0, len(noise), 12))
    verdict = lambda t: quality.measure(t, press)[-1]
    assert verdict(prose) and not verdict(noise) and not verdict(" ".join(f"same{i % 90} words" for i in range(2000)))
    half = prose[:9000] + "".join(f"row {i % 7} of the table;" for i in range(500))
    assert quality.ratios(half.encode(), press)[1] > quality.BAD_CHUNKS


def test_kept_by_hand():
    """The bands by hand: texts and their chunks, at the borders of both."""
    import zstandard

    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    noise = lambda n: " ".join("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(6)) for _ in range(n // 7))
    press = lambda raw: len(raw) / len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(raw))

    def kept(text):
        raw = text.encode()
        counts = brute_quality(text)
        if counts[-1]:
            return False
        least = [1.55, 1.55, 1.5, 1.4, 1.33, 1.18, 0.0][sum(len(raw) <= e for e in (25_600, 6400, 1600, 800, 400, 200))]
        most = [4.5, 3.5, 3.0, 2.75, 2.5, 2.5, 2.25][sum(len(raw) <= e for e in (25_600, 6400, 1600, 800, 400, 200))]
        chunks = [raw[i : i + 2048] for i in range(0, len(raw) - 2047, 2048)] + ([raw[-2048:]] if len(raw) > 2048 and len(raw) % 2048 else [])
        bad = sum(not 1.5 <= press(c) <= 5.0 for c in chunks)
        return least <= press(raw) <= most and (not chunks or bad / len(chunks) <= 0.25)

    seen = set()
    for size in (180, 300, 420, 799, 1000, 2047, 2048, 2049, 4095, 4096, 4097, 7000, 30_000):
        prose = " ".join(rng.choice(words) for _ in range(size))[:size]
        for text in (prose, noise(size + 20)[:size], prose[: size // 2] + noise(size)[: size - size // 2], "one and the same line\n" * (size // 22), " ".join(f"{w} {i}" for i, w in enumerate(prose.split(" ")))[:size]):
            got = quality.measure(text, zstandard.ZstdCompressor(level=quality.LEVEL))
            assert got[-1] == kept(text), (size, text[:40])
            seen.add(got[-1])
    assert seen == {True, False}


def test_predictions_are_the_plain_classifiers():
    """TF-IDF cosines by a dictionary of n-grams, against the matrices."""
    rng = random.Random(5)
    texts = {"a": ["".join(rng.choice("abcdef ") for _ in range(200)) for _ in range(12)], "b": ["".join(rng.choice("uvwxyzé ") for _ in range(200)) for _ in range(12)], "c": ["".join(rng.choice("abcxyz ") for _ in range(200)) for _ in range(12)]}
    count = langid.counts([t for own in texts.values() for t in own])
    idf = (np.log((1 + len(count)) / (1 + (count > 0).sum(0))) + 1).astype(np.float32)
    v = langid.vectors(count, idf)
    centroids = np.concatenate([langid._centroids(v[k * 12 : k * 12 + 12], 4) for k in range(3)])
    model = {"langs": list(texts), "centroids": centroids, "owner": np.repeat(np.arange(3), 4), "idf": idf, "least": np.full(12, 0.3)}

    def grams(text):
        raw, out = bytearray(), {}
        for b in text.lower().encode():
            c = b if b >= 128 or chr(b).isalpha() else 32
            if not (c == 32 and raw and raw[-1] == 32):
                raw.append(c)
        for g in langid.ORDERS:
            for i in range(len(raw) - g + 1):
                h = int.from_bytes(raw[i : i + g], "big")
                k = ((h + g * 0x1000193) * 0x9E3779B1 & 0xFFFFFFFF) >> 20
                out[k] = out.get(k, 0) + 1
        return out

    probes = ["abc def", "uvw Xyz é", "xyz abc xyz", "12 abc--def  fed", "zzz"]
    langs, scores, _ = langid.predict(probes, model)
    for t, lang, score in zip(probes, langs, scores, strict=True):
        own = {k: math.sqrt(n) * float(idf[k]) for k, n in grams(t).items()}
        length = math.sqrt(sum(x * x for x in own.values()))
        cosines = [sum(x * float(c[k]) for k, x in own.items()) / length for c in centroids]
        best = max(range(12), key=lambda j: (cosines[j], -j))
        assert lang == "abc"[best // 4] and score == pytest.approx(cosines[best], abs=2e-5)


def test_language_vectors():
    one, two = langid.counts(["Ab1 2c"]), langid.counts(["zz", "Ab1 2c"])
    assert (one[0] == two[1]).all() and langid.counts([""]).sum() == 0
    model = {"langs": [], "centroids": np.zeros((0, langid.DIM), np.float32), "owner": np.zeros(0, np.int64), "idf": np.ones(langid.DIM, np.float32), "least": np.zeros(0)}
    assert langid.predict(["abc", None, "123"], model) == (["und"] * 3, [0.0] * 3, [True] * 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAb \n\té1"), max_size=40), min_size=1, max_size=4))
def test_shingle_sets(texts):
    import re
    import string

    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        want.append({tuple(w)} if 0 < len(w) < 4 else {tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    sets = jaccard_join.Sets(pa.array(texts, pa.string()))
    assert sets.n.tolist() == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            a, b = (set(sets.tokens[sets.at[k] : sets.at[k + 1]].tolist()) for k in (i, j))
            assert len(a & b) == len(want[i] & want[j]) and (not want[i] or (sets.cls[i] == sets.cls[j]) == (want[i] == want[j]))


@pytest.mark.parametrize("percent", [80, 85, 97])
@pytest.mark.parametrize("size", [2, 3, 7, 24, 63, 64, 234, 235, 236, 255, 256, 257, 900, 3000])
def test_similar_sets_share_a_key(size, percent):
    """Whatever shingles are rare, frequent or not counted: sets near the bound meet, in classes of size on either side, under keys in proportion to their size."""
    rng = np.random.default_rng(size * 100 + percent)
    for trial in range(12):
        base = rng.choice(1 << 62, 3 * size + 20, replace=False).astype(np.uint64)
        # b is a without some and with some others, as unlike as the bound allows
        gone = rng.integers(0, size - -(-percent * size // 100) + 1)
        more = max(0, 100 * (size - gone) // percent - size)
        a, b = base[:size], np.concatenate([base[gone:size], base[size : size + rng.integers(0, more + 1)]])
        common = len(np.intersect1d(a, b))
        if 100 * common < percent * len(np.union1d(a, b)) or len(b) < 2:
            continue
        rare = (0.0, 0.5, 0.9, 1.0)[trial % 4]
        rank = {int(x): 0 if rng.random() < rare else int(rng.choice([1, 5, 63])) for x in base}
        t, doc, ranks, place = [], [], [], []
        for d, own in enumerate((a, b)):
            own = sorted(own.tolist(), key=lambda x: (rank[x], x))
            t += own
            doc += [d] * len(own)
            ranks += [rank[x] for x in own]
            place += range(len(own))
        keys, owners = jaccard_join.prefix_keys(np.array(t, np.uint64), np.array(doc), np.array(ranks), np.array(place), np.array([len(a), len(b)]), percent)
        assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())
        assert np.bincount(owners).max() <= 2.5 * max(len(a), len(b)) + 6


def test_sketches_prove_only_what_is_true():
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(40):
        own = list(base)
        for i in rng.integers(0, 400, k):
            own[i] = f"x{k}_{i}"
        texts.append(" ".join(own))
    sets = jaccard_join.Sets(pa.array(texts))
    sk = sets.sketches().view(np.uint64)
    for i in range(40):
        a = set(sets.tokens[sets.at[0] : sets.at[1]].tolist())
        b = set(sets.tokens[sets.at[i] : sets.at[i + 1]].tolist())
        similar = 100 * len(a & b) >= 85 * len(a | b)
        assert not (similar and jaccard_join._apart(sk[0], sk[i], sets.n[0], sets.n[i], 85))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_spans_cover_every_window_once(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 50, 99, 100, 101, 400]))) for _ in range(5)]
    raw, at = text_bytes(pa.array(texts))
    found = suffix_dedup.spans(raw, at)
    windows = [(d, p) for d, t in enumerate(texts) for p in range(at[d], at[d + 1] - 99)]
    got = [] if found is None else [(int(d), p) for d, a, b in zip(*found[:3], strict=True) for p in range(a, b + 1)]
    assert got == windows
    if found:
        assert all(a <= x <= a + 68 and b <= x for a, b, x in zip(found[1], found[2], found[3], strict=True))


def test_leftmost_least():
    v = np.random.default_rng(1).integers(0, 5, 300).astype(np.uint32)
    got = suffix_dedup.leftmost_least(v, 69)
    assert got.tolist() == [i + int(v[i : i + 69].argmin()) for i in range(300 - 68)]


def test_merged_ranges():
    x, y, own = suffix_dedup.merged(np.array([0, 5, 20, 3]), np.array([6, 8, 30, 9]), np.array([0, 0, 0, 1]))
    assert [x.tolist(), y.tolist(), own.tolist()] == [[0, 20, 3], [8, 30, 9], [0, 0, 1]]


def test_kept_bytes():
    assert suffix_dedup.kept_bytes(b"0123456789", [{"x": 2, "y": 4}, {"x": 3, "y": 6}, {"x": 6, "y": 7}, {"x": 9, "y": 10}]) == (b"0178", 2)


def small_code():
    raw = np.frombuffer(b"some text to count, with e more often \xc3\xa9", np.uint8)
    single, pairs = np.zeros((256, 256), np.int64), np.zeros((1 << 16, 256), np.int64)
    np.add.at(single, (raw[:-1], raw[1:]), 5)
    np.add.at(pairs, (raw[:-2].astype(int) << 8 | raw[1:-1], raw[2:]), 5)
    some = np.flatnonzero(pairs.sum(1))[:20]
    return context_mixing.Code(single, some, pairs[some])


def test_huffman_codes_are_complete():
    code = small_code()
    length = code.length.reshape(276, 256).astype(float)
    assert np.allclose((2.0**-length).sum(1), 1)
    assert length[ord("t"), ord(" ")] < length[ord("t"), ord("q")]


def test_packed_counts():
    n = np.array([0, 1, 2, 15, 32, 33, 40, 1000, 10**6, 10**12])
    got = context_mixing.LEVELS[context_mixing.packed_counts(n, n[::-1]) & 255]
    assert (got[:5] == n[:5]).all() and (got <= n).all() and (got[5:9] >= 0.94 * n[5:9]).all()


def test_counts_of_bits():
    """Each bit is counted once in each table, over buffers that fill up, and blocks survive being packed."""
    code, text = small_code(), "some text, more often " * 60_000
    batch = pa.RecordBatch.from_arrays([pa.array([text[: len(text) // 2], "", text[len(text) // 2 :]])], ["text"])
    (got,) = context_mixing._table_blocks(iter([batch]), types.SimpleNamespace(value=code))
    rows = [context_mixing.grown(x.as_buffer(), context_mixing.BLOCK) for x in got["packed"]]
    total = np.zeros(context_mixing.HASHED, np.int64)
    np.add.at(total, got["block"].to_numpy() // ((2 << context_mixing.SLOT_BITS) // context_mixing.BLOCK), [int(x.sum()) for x in rows])
    raw, at = text_bytes(batch.column("text"))
    bits = sum(int(code.length[code.context(s.before, s.raw)].sum()) for a, b in context_mixing.blocks(raw, at) for s, _ in context_mixing.pieces(raw, at, a, b))
    assert bits > 1 << 22 and total.tolist() == [bits] * context_mixing.HASHED
    assert context_mixing.grown(pa.py_buffer(context_mixing.shrunk(np.array([0, 255, 256, 2**32 - 1], np.uint32))), 4).tolist() == [0, 255, 256, 2**32 - 1]


def random_mixer(code):
    rng = np.random.default_rng(1)
    tables = context_mixing.packed_counts(*rng.integers(0, 40, (2, context_mixing.HASHED << context_mixing.SLOT_BITS)))
    return context_mixing.Mixer(code, tables, rng.normal(0.2, 0.1, (context_mixing.PREDICTORS, context_mixing.GATES)).astype(np.float32))


def whole_score(mixer, texts, known=None):
    """log10 probability of texts, as the operator reads them."""
    found = pa.array(known or [None] * len(texts), pa.list_(pa.struct([("key", pa.int64()), ("ahead", pa.binary()), ("n", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), found], ["text", "found"])
    score, map_ = np.zeros(len(texts)), None
    for symbols, match, a, n, first in context_mixing._read(batch, {}, 2):
        if first:
            map_ = np.zeros((1 << 16, 2), np.float32) if len(symbols.raw) >= context_mixing.PIECE else None
        score[a : a + n] += mixer.score(symbols, match, n, map_)
    return score


def test_symbol_probabilities_add_up():
    """Over all bytes that may follow, the probabilities sum to one."""
    mixer = random_mixer(small_code())
    raw = np.arange(256, dtype=np.uint8)
    symbols = context_mixing.Symbols(raw, np.arange(257), None, False)
    match = np.full(256, ord("t"), np.uint8), np.full(256, 2, np.uint8)
    for m in (None, match):
        assert (10 ** mixer.score(symbols, m, 256)).sum() == pytest.approx(1, abs=1e-5)


def scalar_score(mixer, text, known):
    """The same model read one bit after the other."""
    cm, m64 = context_mixing, (1 << 64) - 1
    code, raw = mixer.code, text.encode() + b"\xff"
    padded, seen, total = b" " * 6 + raw, {}, 0.0

    def mixed(x):
        return int(cm.mix(np.array([x & m64], np.uint64))[0])

    def word_hash(own):
        return sum(int(cm.BYTE[b]) * pow(cm.PRIME, i, 1 << 64) for i, b in enumerate(own)) & m64

    found = {k: v for k, v in known.items() if v[1] >= 2}
    ahead, kind, upto = b"", 0, 0
    for at, byte in enumerate(raw):
        i = at + 6
        if at >= upto and at >= cm.ANCHOR:
            e = [int.from_bytes(raw[at - k : at - k + 8], "little") for k in (24, 16, 8)]
            if (e[2] * cm.PRIME & m64) >> (64 - cm.EVERY_BITS) == 0:
                key = mixed(mixed(e[0] * cm.PRIME + e[1]) + e[2])
                key = key - (1 << 64) if key >> 63 else key
                if key in found:
                    ahead, kind = found[key][0], 1 if found[key][1] < cm.LONG else 2
                    same = 0
                    while same < len(ahead) and at + same < len(raw) and ahead[same] == raw[at + same]:
                        same += 1
                    begin, upto = at, min(at + min(same + 1, len(ahead)), len(raw))
        back = int.from_bytes(padded[i - 6 : i][::-1], "little")
        hashes = []
        for order in cm.ORDERS:
            h = ((back & (1 << 8 * order) - 1) + order) & m64
            h = (h ^ h >> 23) * 0x9E3779B97F4A7C15 & m64
            hashes.append((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 32)
        start = i
        while start > 0 and padded[start - 1] > 32:
            start -= 1
        ends = [j for j in range(1, start) if padded[j] <= 32 < padded[j - 1]]
        before = 0
        if ends:
            a = ends[-1]
            while a > 0 and padded[a - 1] > 32:
                a -= 1
            before = mixed(word_hash(padded[a : ends[-1]]) + 1)
        hashes.append(mixed(word_hash(padded[start:i]) + before * cm.PRIME + i - start) >> 32)
        tree = int(code.tree[padded[i - 2] << 8 | padded[i - 1]])
        pair = tree << 8 | byte
        guess, live = (tree << 8 | ahead[at - begin], True) if at < upto else (0, False)
        for d in range(code.length[pair]):
            node, turn = int(code.node[code.begin[pair] + d]), int(code.turn[code.begin[pair] + d])
            slots = [((h + node * 0x9E3779B1) * 0x85EBCA6B % (1 << 32) >> (32 - cm.SLOT_BITS)) + (k << cm.SLOT_BITS) for k, h in enumerate(hashes)]
            values = [int(mixer.inputs[s]) for s in slots]
            gate = (values[0] & 3) + 4 * (values[2] & 3 > 0) + 8 * (kind if live else 0)
            w = mixer.weights[:, gate].astype(float)
            z = w[0] * code.odds[node] + sum(w[1 + k] * v / cm.SCALE for k, v in enumerate(values)) + w[-1]
            if live:
                told = int(code.turn[code.begin[guess] + d])
                z += w[-2] * (2 * told - 1)
                live = told == turn
            p = 1 / (1 + math.exp(-max(-14, min(14, z))))
            key = ((back & 0xFFFF) * 0x9E3779B1 + node * 0x9E3779B1) * 0x85EBCA6B % (1 << 32) >> 18, int(p * 3.999), d
            n0, n1 = seen.get(key, (0, 0))
            seen[key] = n0 + 1 - turn, n1 + turn
            p = (n1 + cm.TRUST * p) / (n0 + n1 + cm.TRUST)
            total += math.log10(p if turn else 1 - p)
    return total


def test_scores_are_the_scalar_models():
    """Blocks of texts, matches and maps give what one bit after the other gives."""
    mixer = random_mixer(small_code())
    prose = "The count of words, and the count of lines; with some more text often. " * 6
    raw = (prose + "x").encode()
    text, place, key = context_mixing.anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    known = [{"key": int(k), "ahead": raw[p : p + 50] + b"?", "n": n} for k, p, n in zip(key, place, (2, 7, 1) * len(key), strict=False)]
    assert known
    texts = ["", "a", " two  spaces\n", "été 有害 😀", prose, prose[:200] + "X" + prose[230:], "no anchors"]
    got = whole_score(mixer, texts, [known if t.startswith("The") else None for t in texts])
    own = {k["key"]: (k["ahead"], k["n"]) for k in known}
    for t, g in zip(texts, got, strict=True):
        assert g == pytest.approx(scalar_score(mixer, t, own if t.startswith("The") else {}), rel=2e-3, abs=2e-3), t
    assert not np.allclose(whole_score(mixer, [prose]), whole_score(mixer, [" ".join(reversed(prose.split(" ")))]))


def test_long_texts_in_pieces(monkeypatch):
    """A text in pieces is worth about what it is whole, and the pieces cover it."""
    mixer = random_mixer(small_code())
    text = "".join(random.Random(3).choice("abcde ,") for _ in range(40_000))
    whole = whole_score(mixer, [text])
    monkeypatch.setattr(context_mixing, "PIECE", 3000)
    assert whole_score(mixer, [text, "short"])[0] == pytest.approx(whole[0], rel=0.02)
    raw, at = text_bytes(pa.array([text]))
    parts = list(context_mixing.pieces(raw, at, 0, 1))
    assert b"".join(p.raw.tobytes() for p, _ in parts) == text.encode() + b"\xff" and [w.stop for _, w in parts[:2]] == [3000, 6000]


def test_chance_of_a_rare_turn():
    """A turn that came after many of the other kind cost minus infinity: 1 less a chance that rounds to 1."""
    turn = np.append(np.ones(100_000, np.uint64), np.uint64(0))
    for flip in (np.uint64(0), np.uint64(1)):
        p = np.full(len(turn), 8e-7 if flip else 1 - 8e-7, np.float32)
        key = np.arange(len(turn), dtype=np.uint64) << np.uint64(1) | turn ^ flip
        for before in (None, np.zeros((1 << 16, 2), np.float32)):
            left = None if before is None else np.zeros_like(before)
            got, text = context_mixing.refined(p, key.copy(), np.arange(len(turn)), before, left)
            unlikely = float(p[0]) if flip else 1 - float(p[0])
            assert got[-1] == pytest.approx(context_mixing.TRUST * unlikely / (100_000 + context_mixing.TRUST), rel=1e-3)
            assert got[:-1].min() > 0.999 and not text.any()
            assert left is None or left[0].tolist() == ([100_000, 1] if flip else [1, 100_000])


def test_words_of_a_column():
    texts = ["", " A b\ta ", "x", None, "É\u00a0é B", "\n\n"]
    words = context_mixing.Words(pa.array(texts, pa.string()))
    distinct = words.distinct.to_pylist()
    got = [[distinct[c].decode() for c in words.codes[a:b]] for a, b in zip(words.at, words.at[1:], strict=False)]
    assert got == [[], ["a", "b", "a"], ["x"], [], ["É\u00a0é", "b"], []]


@pytest.mark.parametrize("more", [[], [None]])
def test_words_of_a_slice(more):
    """words of a slice of a column without nulls were made of other rows' bytes."""
    texts = ["ab", "Cd e", "f", " ", "", "G h", *more]
    for a in range(len(texts)):
        for b in range(a + 1, len(texts) + 1):
            words = context_mixing.Words(pa.array(texts, pa.string()).slice(a, b - a))
            distinct = words.distinct.to_pylist()
            got = [[distinct[c].decode() for c in words.codes[x:y]] for x, y in zip(words.at, words.at[1:], strict=False)]
            assert got == [(t or "").lower().split() for t in texts[a:b]]


def test_slices_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "", "b" * 50, "c", "d" * 9])], ["doc_id", "text"])
    parts = list(slices(batch, "text", 12))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 1
    raw, at = text_bytes(parts[-1].column("text"))
    assert len(at) == parts[-1].num_rows + 1 and at[-1] == len(raw)
    assert zlib.crc32(text_bytes(batch.column("text").slice(2, 2))[0].tobytes()) == zlib.crc32(b"b" * 50)


@pytest.mark.parametrize("size", [2500, 3500, 6000, 20_000])
def test_half_noise_is_rejected(size):
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = " ".join(rng.choice(words) for _ in range(9000))
    noise = " ".join("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(3, 10))) for _ in range(4000))
    assert quality.measure(prose[:size], press)[-1]
    for share in (0.5, 0.7):
        cut = int(size * (1 - share))
        assert not quality.measure(prose[:cut] + noise[: size - cut], press)[-1]
    tail = prose[:4096] + noise[:2000]  # nothing but the partial chunk is noise
    assert quality.ratios(tail.encode(), press)[1] == 1 / 3


def test_copies_take_one_place_of_the_rerank():
    """A third of a full block are copies of one vector: its nearest distinct vectors are found all the same."""
    rng = np.random.default_rng(5)
    n, third = ann.BLOCK, ann.BLOCK // 3
    x = rng.normal(size=(n, 64)) * np.linspace(1.5, 0.5, 64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:third] = x[0]
    ids = rng.permutation(n)
    pivots = x[third : third + ann.PIVOTS]
    block = ann.Block(ids, x, pivots, 10)
    near = third + np.argsort(((x[third:] - x[0]) ** 2).sum(1))[:40]
    hits = []
    for j in near.tolist():
        true = np.sqrt(((x - x[j]) ** 2).sum(1))
        got, gaps = block.search(x[j], ann.nearest_pivots(x[j : j + 1], pivots)[0], ann.RERANK)
        first, want = np.lexsort((got, gaps))[:11], np.lexsort((ids, true))[:11]
        hits.append(len(set(got[first].tolist()) & set(ids[want].tolist())) / 11)
    assert np.mean(hits) >= 0.95 and min(hits) >= 0.6, (np.mean(hits), min(hits))


def test_copies_of_a_vector_count_each():
    """What is kept of a group of copies holds its k smallest rows, whichever id is left out."""
    ids = np.array([3] * 30 + [4] * 12 + list(range(5, 40)))
    block = ann.Block(ids, np.ones((len(ids), 4)), np.ones((1, 4)), 10)
    got, gaps = block.search(np.ones(4), np.zeros(1, np.int64), ann.RERANK)
    assert not gaps.any()
    for own in (3, 4, 99):
        assert sorted(got[got != own].tolist())[:10] == sorted(ids[ids != own].tolist())[:10]
