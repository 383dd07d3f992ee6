"""The registered queries and stages on Spark, against brute force, and odd rows."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
from tidewater.llm import ann, bpe, context_mixing, jaccard_join, langid, packing, quality, registry, suffix_dedup, token_counts, url_rules
from tidewater.llm.components import connected_components

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SMALL = entry.SMALL
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, an extra column with a clashing name."""
    rows = [(1, "Un deux trois", "fr", None, 1), (1, "Un deux trois", "fr", None, 1), (None, "no id " * 30, None, "s", 1), (2, None, "en", "s", None), (3, "", "en", "s", 0), (4, " \n ", None, None, 0), (5, "long " * 60_000, "en", "s", 1), (6, "one two three four five six", "en", "s", 1), (-7, "1234 5678", None, None, 1), (1, "other text, same id", "en", "s", 1)]
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], f"{COLUMNS}, score string, k1 int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_registry():
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in registry.queries()}
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


def test_urls_equal_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.sql(f"create view pages as from '{SMALL}/pages.parquet'")
    want = db.sql(url_rules.ORACLE)
    got = url_rules.query(spark, SMALL)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_urls_by_brute_force(spark):
    rng = random.Random(5)
    hosts = ["", "a", "b.a", "c.b.a", "x.b.a", "ba", "b.ca", "a.b", "z.a.b", "A", "C.B.a", "a:80", ".a", "a."]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q', '/p?x=/p/q', '?q', '#/p', '/P'])}" for _ in range(600)] + [None, "nothing", "a/b", "x://y://b.a/p"]
    rules = [("a", "/", "block"), ("b.a", "/p", "allow"), ("c.b.a", "/", "block"), ("a.b", "/p/q", "block"), ("b", "", "allow"), ("B.A", "/p/q", "block"), (None, "/", "block")]

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOW)
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
        best = max(((len(h + p), len(h), v, h.translate(LOW) + p) for h, p, v in rules if h and (host == h.translate(LOW) or host.endswith("." + h.translate(LOW))) and path.startswith(p)), default=(0, 0, "allow", None))
        return host, path, best[3], best[2]

    for n in ("4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r[0]: tuple(r)[1:] for r in url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_rules.rules_frame(spark, rules)).collect()}
        assert got == {i: judge(u) for i, u in enumerate(urls)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string"), url_rules.rules_frame(spark, rules)).count() == 0


def test_quality_on_spark(spark, odd, empty):
    got = quality.quality_report(odd).collect()
    assert len(got) == odd.count() and {r["doc_id"]: r["n_words"] for r in got}[2] == 0
    assert quality.keep_good(odd).columns == odd.columns and quality.quality_report(empty).count() == 0


def test_language_accuracy(spark):
    rows = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] > 0.97 and held[1] > 100 and rows.where("rejected").count() <= 3
    assert rows.where("score < 0 or score > 1").count() == 0
    bad = [r for r in rows.select("doc_id", "held_out").collect() if r[1] != (zlib.crc32(str(r[0]).encode()) % 5 == 0)]
    assert not bad


def test_language_odd(spark, odd, empty):
    model = langid.fit(odd, ~langid.held_out(F.col("doc_id")))
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4, -7)} == {"und"}
    assert langid.keep_identified(odd, model).columns == odd.columns
    nothing = langid.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"} and langid.identify(empty, model).count() == 0


def test_every_language_is_learned(spark):
    """More languages than the sample has rows for: one row at least of each, and copies of one row are no more than one."""
    rng = random.Random(6)
    rows = []
    for k in range(2100):
        word = "".join(rng.choice(string.ascii_lowercase) for _ in range(9))
        rows += [(2 * k + j, f"{word} " * 20, f"l{k:04d}") for j in range(2)]
    rows += [(1, "same again " * 9, "l0000")] * 3000
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), sample=500)
    assert model["langs"] == sorted({r[2] for r in rows}) and set(model["owner"].tolist()) == set(range(2100))
    texts = [r[1] for r in rows[10:4200:700]]
    assert langid.predict(texts, model)[0] == [r[2] for r in rows[10:4200:700]]


def test_bpe_on_spark(spark, odd, empty, docs):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r[0]: tuple(r)[1:] for r in bpe.query(spark, SMALL).collect()}
    for i, t in docs:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[i] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(odd, path, pattern).count() == odd.count() and bpe.round_trip(empty, path, pattern).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(odd, path, pattern), path, pattern).collect()
    assert sorted((r["text"] for r in back)) == sorted((r["text"] or "" for r in odd.collect()))


def test_token_counts_on_spark(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.count_tokens(odd, path).collect()
    assert len(got) == odd.count() and {r["doc_id"]: r["over_limit"] for r in got}[5] and token_counts.count_tokens(empty, path).count() == 0
    for other in ("byte_bpe_50k.json", "piece_bpe_32k.model"):  # their tokens hold spaces
        with pytest.raises(ValueError, match="spaces"):
            token_counts.count_tokens(odd.select("doc_id", "text"), public_tokenizers.path(other))


def test_packing_on_spark(spark, odd, empty, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.paths()[0])
    for frame, texts in ((packing.query(spark, SMALL), docs), (packing.pack(odd, packing.paths(), shard=3), [tuple(r) for r in odd.select("doc_id", "text").collect()])):
        rows = frame.collect()
        want = collections.Counter()
        for i, t in texts:
            ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            first = len(ids) % 2048 or min(len(ids), 2048)
            cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
        assert collections.Counter(tuple(r)[:5] for r in rows) == want
        places = collections.defaultdict(list)
        for r in rows:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in places.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= 2048
        if texts is docs:
            assert len(places) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 2
    assert packing.pack(empty, packing.paths()).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x[100:400] = x[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, []), (1200, [0.0] * 8), (1300, [float("nan")] * 8), (1400, [1.0, None] * 4), (None, [1.0] * 8), (1500, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 100 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 100))
    hit = 0
    for q, found in got.items():
        gaps = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(900), gaps)) if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(f[2] == pytest.approx(gaps[f[1]], abs=0) for f in found)
        hit += len({f[1] for f in found} & set(best))
        if q in (0, 100, 200, 300):
            assert [f[1] for f in found] == best
    assert hit >= 0.9 * 90
    assert ann.search(df.where("vec_id >= 1000"), df).count() == 0
    few = df.where("vec_id in (0, 500, 600)")
    assert ann.search(few, few, block=1).count() == 6


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    got = ann.query(spark, "/root/testdata/sf0.1").collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q, own in found.items():
        gaps = ((x - x[ids == q][0]) ** 2).sum(1)
        hit += len(own & set([i for i in ids[np.lexsort((ids, gaps))].tolist() if i != q][:10]))
    assert hit >= 0.9 * 10 * len(found) and len(found) == sum(i % 100 == 0 for i in ids)


def brute_removal(texts, seen=None):
    seen, out = set(), {}
    for i, t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(raw[p : p + 100])
        runs = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(raw)))
        out[i] = len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()
    return out


@pytest.mark.parametrize("part", [20_000, 3])
def test_removal(spark, docs, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rows = docs[:120] + [(10_000, "a" * 900), (10_001, "ab" * 400), (10_002, ""), (10_003, docs[3][1]), (10_004, "xyz" + docs[3][1][50:] + docs[7][1]), (10_005, "a" * 120), (10_006, docs[7][1][:99]), (10_007, None), (10_008, docs[7][1][10:110])]
    rows += [(20_000 + k, f"{k:05d}" * 9 + docs[5][1][:130] + f"{k * 7:05d}" * 9) for k in range(40)]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_removal(sorted(rows))


def test_removal_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    rng = random.Random(2)
    one = "".join(rng.choice("abcdef ") for _ in range(5000))
    rows = [(1, one), (2, one[1000:1900] + "x" + one[300:420]), (3, one[:2000] + "é" + one[500:])]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == brute_removal(rows)


def test_removal_odd(spark, odd, empty):
    got = suffix_dedup.removal_report(odd).collect()
    assert len(got) == odd.count() and suffix_dedup.removal_report(empty).count() == 0
    assert {r["n_removed"] for r in got if r["doc_id"] == 1} == {0}
    clash = {c: F.lit(i) for i, c in enumerate(("k2", "ranges", "known", "more", "asked", "part", "column_1", "x", "_cls", "_n"))}
    wide = odd.withColumns(clash)
    cut = suffix_dedup.cut_repeats(wide)
    assert cut.columns == wide.columns and cut.count() == odd.count()
    assert {(r["k1"], r["k2"], r["ranges"], r["_n"]) for r in cut.collect()} == {(3, 0, 1, 9)}


def brute_groups(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    post, shared, top = collections.defaultdict(list), collections.Counter(), {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sorted(sets):
        for s in sets[i]:
            for j in post[s]:
                shared[j, i] += 1
            post[s].append(i)
    links = {(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)}
    for a, b in links:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}, links


@pytest.fixture(scope="module")
def alike(docs):
    rng = random.Random(1)
    base = docs[0][1].split()
    rows = docs[:100]
    for k in range(40):
        own = list(base)
        for _ in range(rng.randint(1, 30)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
        rows.append((20_000 + k, " ".join(own)))
    rows += [(30_000 + k, " ".join([*base[:120], *(f"z{rng.randrange(10**6)}" for _ in range(rng.randint(3, 40)))])) for k in range(30)]
    return rows + [(40_000, None), (40_001, ""), (40_002, "One two"), (40_003, "one  TWO"), (40_004, "   ")]


@pytest.mark.parametrize("least_df", [8, 2])
def test_groups(spark, alike, least_df, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAST_DF", least_df)
    got = {r[0]: tuple(r)[1:] for r in jaccard_join.components(spark.createDataFrame(alike, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_groups(alike)[0]


def test_all_links(spark, alike):
    links, rows = jaccard_join.all_links(spark.createDataFrame(alike, "doc_id long, text string"), 5, 80)
    cls = {r["doc_id"]: r["cls"] for r in rows.collect()}
    want = {tuple(sorted((cls[a], cls[b]))) for a, b in brute_groups(alike, 5, 80)[1] if cls[a] != cls[b]}
    assert {tuple(r) for r in links.select("a", "b").collect()} == want


def test_groups_odd(spark, odd, empty):
    got = jaccard_join.components(odd).collect()
    assert len(got) == odd.count() and jaccard_join.components(empty).count() == 0
    kept = jaccard_join.keep_one(odd, 5, 80)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 2 and kept.where("doc_id is null").count() == 1 and kept.count() == odd.count() - 1


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    top = {}

    def root(i):
        top.setdefault(i, i)
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(links, "u long, v long"))[0].collect()}
    assert got == {i: root(i) for i in top}
    assert connected_components(spark.createDataFrame([], "u long, v long"))[0].count() == 0


@pytest.mark.parametrize("hot", [400_000, 300])
def test_mixing(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(context_mixing, "HOT", hot)
    rows = context_mixing.query(spark, SMALL).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: [*(w.encode() for w in words((t or "").translate(LOW))), None] for i, t in docs}
    count = collections.Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(count[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r["score"] < 0
    unseen = [r["bits_per_byte"] for r in rows if r["held_out"]]
    assert 1 < sum(unseen) / len(unseen) < 3.2  # eight bits a byte are what no model needs


def test_mixing_odd(spark, odd, empty):
    own = odd.select("doc_id", context_mixing.held_out(F.col("doc_id")).alias("held_out"), "text")
    got = context_mixing.score(own, context_mixing.Trained(own.where("not held_out"))).collect()
    assert len(got) == odd.count() and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    nothing = context_mixing.Trained(empty)
    assert {r["n_known"] for r in context_mixing.score(own, nothing).collect()} == {0}


def test_base_score_where_parts_cut_batches(spark, monkeypatch, tmp_path):
    """F1: rows after the first of a batch's parts were counted and scored with other rows' bytes."""
    monkeypatch.setattr(context_mixing, "PART", 3000)
    rows = [(i, " ".join(f"W{(i * k) % 97}" for k in range(i % 40))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*words(t.translate(LOW)), None] for i, t in rows}
    count = collections.Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in context_mixing.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, own in tokens.items():
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(own), sum(count[w] > 0 for w in own), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel=1e-12)


def test_weights_are_learned_from_every_text(spark):
    """only every 16th training text by hash taught the weights."""
    rows = spark.range(8).selectExpr("id as doc_id", "repeat(concat('the cat ', id, ' sat on the mat '), 40) as text").where("pmod(xxhash64(text), 16) != 0")
    assert rows.count() > 1
    code, counts, weights = context_mixing.Trained(rows).model.value
    assert not np.allclose(weights, context_mixing.Mixer(code, counts).weights)


def test_mixing_shuffles_no_text(spark, monkeypatch):
    """Before, learning and scoring each joined whole texts with their passages, which took more disk than there was."""
    plans, whole = {}, context_mixing.stored

    def stored(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return whole(df, name, *more)

    monkeypatch.setattr(context_mixing, "stored", stored)
    context_mixing.query(spark, SMALL)
    assert "Exchange" in plans["mixing-passages"] and "Exchange" not in plans["mixing-scored"]


def test_passages_reach_the_texts_of_their_part(spark, monkeypatch):
    """Whether tasks know passages beforehand or find them by part, in parts of any size, scores are the same."""
    text = "repeat(concat(sha2(cast(id % 3 as string), 512), ' and ', sha2(cast(id % 3 + 5 as string), 512), ' '), 8)"
    own = spark.range(0, 12, 1, 2).selectExpr("id as doc_id", "id = 4 as held_out", f"{text} as text")

    def scores():
        docs, _ = context_mixing.in_parts(own)
        trained = context_mixing.Trained(docs.where("not held_out"), docs)
        return docs.select("part").distinct().count(), trained.passages.count(), {r["doc_id"]: r["score"] for r in context_mixing.score(docs, trained).collect()}

    hot, parts = context_mixing.HOT_PASSAGES, []
    for part in (context_mixing.PART, 3000):
        monkeypatch.setattr(context_mixing, "PART", part)
        monkeypatch.setattr(context_mixing, "HOT_PASSAGES", hot)
        known = scores()
        monkeypatch.setattr(context_mixing, "HOT_PASSAGES", 0)
        found = scores()
        assert known[:2] == found[:2] and known[1] > 0 and known[2] == pytest.approx(found[2], rel=1e-6)
        parts.append(known[0])
    assert parts[0] < parts[1]
    monkeypatch.setattr(context_mixing, "passages", lambda docs: spark.createDataFrame([], "key long, ahead binary, n long"))
    assert scores()[2][4] < known[2][4] - 1


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == names
        if name == "near duplicates":
            _, links = brute_groups([tuple(r) for r in docs.select("doc_id", "text").collect()], 5, 80)
            want, _ = brute_groups([tuple(r) for r in before.select("doc_id", "text").collect()], 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == {i for i, (_, top) in want.items() if i == top} and not links
        if name == "repeats":
            want = brute_removal(sorted(tuple(r) for r in before.select("doc_id", "text").collect()))
            for r in docs.collect():
                size, gone, _, _ = want[r["doc_id"]]
                assert size - gone - 6 * 40 <= len(r["text"].encode()) <= size - gone
    assert corpus_pipeline.run(spark, SMALL).count() == counts[-1] and counts[1] <= counts[0]


def test_urls_without_rules(spark):
    got = url_rules.judge_urls(spark.createDataFrame([(1, "http://a/b"), (None, None)], "page_id long, url string"), url_rules.rules_frame(spark, []), default="block").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "a", "/b", None, "block"), (None, "", "", None, "block")]


def test_groups_of_many_near_copies(spark, monkeypatch):
    """Copies that are similar to some of the others only: lists with many pairs give a forest first."""
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(170)], []
    for k in range(160):
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(170)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    kept = []
    forest = jaccard_join._List.forest
    monkeypatch.setattr(jaccard_join._List, "forest", lambda self: kept.append(1) or forest(self))
    want = brute_groups(rows)[0]
    got = {r[0]: tuple(r)[1:] for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len({c for _, c in want.values()}) > 1


def test_forest_joins_what_is_near():
    rng = random.Random(4)
    base, texts = [f"w{i}" for i in range(170)], []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(170)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    import pyarrow as pa

    sets = jaccard_join.Sets(pa.array(texts))
    own = jaccard_join._List(sets.n, np.arange(60) // 2, sets.sketches().view(np.uint64), 85)
    assert own.pairs(3) is None
    every, some = own.pairs(None), own.forest()

    def groups(pairs):
        top = list(range(60))

        def root(i):
            while top[i] != i:
                i = top[i]
            return i

        for i in range(0, 60, 2):
            top[root(i)] = root(i + 1)
        for x, y in zip(*pairs, strict=True):
            for i, j in zip(np.broadcast_to(x, len(y)).tolist(), y.tolist(), strict=True):
                top[root(i)] = root(j)
        return [root(i) for i in range(60)]

    a, b = groups(every), groups(some)
    assert len(set(a)) == len(set(b)) and len(some[0]) <= 59
    assert all((a[i] == a[j]) == (b[i] == b[j]) for i in range(60) for j in range(60))


def test_removal_of_repeated_rows(spark):
    """Rows with equal id and text are one document, which is no repeat of itself; so are equal texts without an id."""
    a, b = (" ".join(f"{w}{i * i % 97}" for i in range(40)) for w in ("alpha", "beta"))
    rows = [(1, a), (1, a), (2, "first " + a), (None, b), (None, b), (None, b), (7, b + " end")]
    want = sorted((str(i), len(t), gone) for (i, t), gone in zip(rows, [0, 0, len(a), 0, 0, 0, len(b)], strict=True))
    for parts in (1, 7):  # in one slice, and met in the shuffle
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = suffix_dedup.removal_report(frame).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in got) == want
    left = [r["text"] for r in suffix_dedup.cut_repeats(frame).collect()]
    assert left.count(a) == 2 and left.count(b) == 3


def test_one_of_each_group_whatever_its_ids(spark):
    """Rows without an id are decided like others, and an id with two texts by each of them."""
    a, b, c, d = (" ".join(f"{w}{i * i % 97}" for i in range(60)) for w in ("alpha", "beta", "gamma", "delta"))
    rows = [(1, a), (None, a), (None, a + " more"), (None, b), (None, b), (None, b + " more"), (2, c), (2, d), (3, d + " more"), (4, d), (5, c + " more"), (2, c), (1, d), (None, ""), (None, "")]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80).collect()
    texts = collections.Counter((r["text"] or "?").split("0")[0] for r in got)
    assert texts == {"alpha": 1, "beta": 1, "gamma": 1, "delta": 1, "?": 2}
    assert {r["text"].split("0")[0]: r["doc_id"] for r in got if r["text"]} == {"alpha": 1, "beta": None, "gamma": 2, "delta": 1}
