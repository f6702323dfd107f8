"""Each operator on small tables with the cases that its docstring defines, against brute force where SQL is none."""

import collections
import hashlib
import math
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_pipeline import pack as stage_of_packing
from inkmesh.llm import bpe, common, dedup, html, jaccard, langid, lm, packing, queries, topk, urlfilter, warc

from ..conftest import DATA, same

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  ", "a", "A b\tc", "don't I'LL 's", "a\x1cb\x85c\xa0d", "ΟΔΟΣ İx ß ﬁ é", "<|endoftext|>x<|startoftext|>", "x" * 400 + " " + "ab" * 300, "日本語😀", " lead ", "a b c\n" * 3000]


def docs(spark, texts=ODD, extra=True):
    """Documents with a null id, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(4, texts[4], "en", "s", 1), (None, "a", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"score": F.lit("mine"), "offset": F.lit(1), "ids": F.lit("mine"), "kept": F.lit(0), "N": F.lit(2), "count": F.lit(3), "key": F.lit("k")}) if extra else df


@pytest.mark.parametrize("name", [n for n in queries.oracle_sql()])
def test_query_matches_sql(spark, duck, name):
    same(queries.queries()[name](spark, DATA), duck, queries.oracle_sql()[name])


# 1 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_bpe_equals_the_library(spark, tokenizer):
    df = docs(spark)
    for r in bpe.encode(df, PATH, decoded="out").select("text", "ids", "n_tokens", "out").collect():
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.out == tokenizer.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_bpe_query(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = queries.op1_bpe(spark, DATA).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abthein é'sdlm. \n<|>ÄΣ\u0301!1"), max_size=90))
def test_bpe_property(text):
    want = Tokenizer.from_file(PATH) if not hasattr(test_bpe_property, "t") else test_bpe_property.t
    test_bpe_property.t = want
    assert np.frombuffer(bpe.WordBpe.load(PATH).encode([text])[0], "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


def test_bpe_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    fresh, kept = bpe.WordBpe(PATH), bpe.WordBpe.load(PATH)
    for text in ("one two three four", "five two six", "one seven, eight."):
        assert fresh.encode([text]) == kept.encode([text])


# 2 -------------------------------------------------------------------------------------------------------------


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_query(spark, tokenizer):
    rows = queries.op2_packing(spark, DATA).collect()
    n = check_packing(rows, 2048)
    assert n <= math.ceil(sum(r.length for r in rows) / 2048) * 1.02 + 1
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(k, 2048 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(np.split(ids, range(2048, len(ids), 2048)))]
        assert sorted(got[d.doc_id]) == want


def test_packing_odd_rows(spark):
    df = docs(spark)
    cut = packing.pieces(df, PATH, with_ids=True)
    assert cut.count() >= df.count()
    check_packing(packing.pack(cut).collect(), 2048)
    assert packing.pack(packing.pieces(df.limit(0), PATH)).count() == 0


def test_packing_documents_takes_one_python_pass(spark, monkeypatch):
    plans, write = [], packing.written

    def written(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args)

    monkeypatch.setattr(packing, "written", written)
    df, columns = docs(spark), ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = stage_of_packing(spark, df, DATA).collect()
    assert len(plans) == 1 and plans[0].count("MapInArrow") == 1
    check_packing(rows, 2048)
    want = packing.pieces(df, PATH).select(columns).collect()
    assert collections.Counter(tuple(r[c] for c in columns) for r in rows) == collections.Counter(map(tuple, want))
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
def test_plan_places_every_piece(lengths):
    hist = np.bincount(lengths, minlength=65)
    slots, n = packing.plan(hist, 64)
    for k in range(1, 65):
        own = slots[slots[:, 0] == k]
        assert own[:, 4].sum() == hist[k] and (np.cumsum(own[:, 4]) - own[:, 4] == own[:, 1]).all()
    fill = np.zeros(n, int)
    for k, _, s, _, times in slots:
        fill[s : s + times] += k
    assert fill.max() <= 64 and n <= math.ceil(sum(lengths) / 64) * 1.3 + 2


def test_patterns_fill_or_nearly():
    p = packing.patterns(np.arange(1, 33), 32)
    assert (p.sum(1) == 32).all() and len(np.unique(p, axis=0)) == len(p) and (np.diff(p, axis=1) <= 0).all()
    p = packing.patterns(np.array([400, 500, 700, 1023]), 2048)
    assert 1023 + 1023 in p.sum(1).tolist() and p.sum(1).max() <= 2048 and p.sum(1).min() >= 0.98 * 2048


LENGTHS = {
    "uniform": lambda r: r.integers(1, 2049, 20_000), "few": lambda r: r.choice([700, 400, 500, 1023], 20_000), "one": lambda r: np.full(1000, 300),
    "short": lambda r: np.clip(r.lognormal(4.5, 0.8, 50_000).astype(int), 1, 2048), "middle": lambda r: np.clip(r.lognormal(6, 0.8, 50_000).astype(int), 1, 2048),
}


@pytest.mark.parametrize("name", LENGTHS)
def test_plan_is_close_to_the_bound(name):
    x = LENGTHS[name](np.random.default_rng(0))
    hist = np.bincount(x, minlength=2049)
    n, alone = packing.plan(hist, 2048)[1], packing._plan(hist, 2048, False)[1]
    assert n <= alone and n <= max(1.005 * math.ceil(x.sum() / 2048), alone)


# 3 -------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "ü<p>" * 300_000
    rows = [(3, "http://a/", "x" * 100), (1, "http://b/", "x" * 100), (2, None, "x" * 99), (4, "u\r\nv", "x" * 99), (5, "c", None), (6, "d", long), (7, "e", long), (None, "f", "y" * 200), (1, "http://b/", "x" * 100), (9, "g", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write(pages)
    out = warc.read(index).collect()
    assert len(out) == len(rows)
    want = {(r[0], (r[2] or "").encode()) for r in rows}
    for r in out:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload)) in want and r.payload_digest == hashlib.sha256(bytes(r.payload)).hexdigest()
    assert {(r.page_id, r.refers_to) for r in out if r.record_type == "revisit"} == {(3, 1), (7, 6)}
    assert next(r for r in out if r.page_id == 7).payload_bytes == len(long.encode())
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_warc_ids_and_dates(spark):
    rows = [("a:b", "u", "x" * 100), ("c%d", "v", "x" * 100), ("e\r\nf", "w", "x" * 100), ("a:b", "u", "x" * 100), (None, "z", "x" * 100)]
    index = warc.write(spark.createDataFrame(rows, "page_id string, url string, html string"), date="2020-02-03T04:05:06Z")
    out = warc.read(index).collect()
    assert sorted((r.page_id, r.refers_to) for r in out if r.page_id) == [("a:b", None), ("a:b", None), ("c%d", "a:b"), ("e\r\nf", "a:b")]
    assert index.select("record_id").distinct().count() == len(rows)
    raw = warc.record("urn:x", 1, "u", b"p", "d", 2, "t", "2020-02-03T04:05:06Z")
    fields = warc.parse(raw)[0]
    assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
    assert fields["WARC-Refers-To-Target-URI"] == "t" and fields["WARC-Date"] == "2020-02-03T04:05:06Z"


def test_warc_frames_stand_alone(spark):
    import zstandard
    from pyarrow import fs

    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 400).alias("html")).coalesce(1)
    index = warc.write(pages, frame_bytes=4096).collect()
    name = index[0].bundle
    store, path = fs.FileSystem.from_uri(name)
    with store.open_input_file(path) as f:
        table = warc.seek_table(f)
        assert len(table) > 20
        r = index[150]
        start, size = table[r.frame]
        f.seek(start)
        raw = zstandard.ZstdDecompressor().decompress(f.read(size))[r.offset : r.offset + r.length]
    assert warc.parse(raw)[2] == str(r.page_id).encode() * 400


# 4 -------------------------------------------------------------------------------------------------------------


def brute_top(rows, k):
    clean = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ask = {}
    for i, v in clean:
        if i % 100 == 0:
            ask[i] = max(ask.get(i, v), v)
    out = set()
    for q, v in ask.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def test_topk_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.standard_normal(4) * (3 if i % 7 == 0 else 0.2)]) for i in range(400)]
    rows += [(500, None), (600, [1.0, None, 0.0, 0.0]), (700, [float("nan"), 0.0]), (701, [float("inf"), 0.0]), (None, [1.0, 1.0]), (800, []), (801, [2.0]), (900, [0.0] * 4)]
    rows += [(7, rows[7][1])] * 3 + [(1000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"norm": F.lit("x"), "part": F.lit("y"), "id": F.lit("z")})
    for parts in (60, 10_000):
        out = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, part_rows=parts, head=20, block=3)
        got = [tuple(r) for r in out.collect()]
        want = brute_top(rows, 10)
        assert collections.Counter((a, b, d) for a, b, _, d in got) == collections.Counter((a, b, d) for a, b, _, d in want)
        assert {(a, c, d) for a, _, c, d in got} == {(a, c, d) for a, _, c, d in want}
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0


def test_topk_large_finite_values(spark):
    rows = [(0, [1e13, 1.0]), (1, [1e13, 2.0]), (2, [1e300, 0.0]), (3, [-1e300, 0.0]), (4, [0.5, 0.5]), (100, [2.0**40, -1.0]), (5, [3.0, 2.0**40])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)
    whole = {i: [max(-(2**63), min(2**63 - 1, math.floor(1024 * x))) for x in v] for i, v in rows}
    for q in (0, 100):
        scored = sorted((-max(-topk.LAST, min(topk.LAST, sum(a * b for a, b in zip(whole[q], w)))), i) for i, w in whole.items() if i != q)
        assert [(r.vec_id, r.score) for r in sorted(out.filter(f"query_id = {q}").collect(), key=lambda r: r.rank)] == [(i, -s) for s, i in scored]


def test_topk_prunes_by_coordinate():
    rng = np.random.default_rng(1)
    c = rng.integers(-100, 100, (5000, 6)).astype(np.int64)
    c = c[np.argsort(-np.linalg.norm(c, axis=1))]
    norm, ids = np.linalg.norm(c, axis=1), np.arange(5000)
    q = c[:40] // 2
    best = topk.Best(np.full(40, -1), np.full(40, -np.inf), 5)
    topk.search(q, np.linalg.norm(q, axis=1), c, ids, norm, best)
    full = q @ c.T
    for i in range(40):
        order = np.lexsort((ids, -full[i]))[:5]
        assert best.vec[i].tolist() == order.tolist()


# 5 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [dedup.sha256, lambda c: F.substring(dedup.sha256(c), 1, 1)])
def test_dedup_also_when_digests_collide(spark, digest):
    texts = ODD + ["A  b c", "a\n", "\ta", "a ", "x y", "x\x0by", "x\x1cy"] * 2
    df = docs(spark, texts)
    got = collections.Counter(tuple(r) for r in dedup.exact_dedup(df, digest=digest).collect())
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    rows = [(r.doc_id, norm(r.text)) for r in df.select("doc_id", "text").collect()]
    by = collections.defaultdict(list)
    for k, t in rows:
        by[t].append(k)
    keep = {t: min((k for k in ks if k is not None), default=None) for t, ks in by.items()}
    assert got == collections.Counter((k, keep[t], len(by[t]), k == keep[t], hashlib.sha256(t.encode()).hexdigest()) for k, t in rows)
    assert dedup.exact_dedup(df.limit(0)).count() == 0
    first = dedup.first_rows(df, digest=digest)
    assert first.columns == df.columns and collections.Counter((r.doc_id, norm(r.text)) for r in first.collect()) == collections.Counter((k, t) for t, k in keep.items())
    assert {(r.doc_id, r.text) for r in first.collect()} <= {(r.doc_id, r.text) for r in df.collect()} and dedup.first_rows(df.limit(0)).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 300), st.integers(0, 2**63)), max_size=120))
def test_elias_fano(values):
    import io

    v = np.array(sorted(values), np.uint64)
    out = io.BytesIO()
    lm.EliasFano.write(out, v)
    ef, at = lm.EliasFano.read(np.frombuffer(out.getvalue(), np.uint8), 0)
    assert at == len(out.getvalue()) and (ef.get(np.arange(len(v))) == v).all()
    ask = np.array([*values, 1, 2, 299, 2**62], np.uint64)
    place = {int(x): k for k, x in enumerate(v)}
    assert ef.find(ask).tolist() == [place.get(int(x), -1) for x in ask]


def lm_words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["\0end"]


def test_lm_equals_plain_counts(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(docs(spark, extra=False).select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    train = df.filter(langid.remainder("doc_id", 10) != 0)
    out = lm.score(df.withColumn("score", F.lit("x")), lm.train(train, order=3)).collect()
    grams = [collections.Counter() for _ in range(3)]
    for r in train.collect():
        w = lm_words(r.text)
        for n in range(3):
            grams[n].update(tuple(w[i : i + n + 1]) for i in range(len(w) - n))
    total, kinds = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for n in (1, 2):
        for g, c in grams[n].items():
            total[n - 1][g[:-1]] += c
            kinds[n - 1][g[:-1]] += 1
    tokens, types = sum(grams[0].values()), len(grams[0])
    want = collections.defaultdict(list)
    for r in df.collect():
        w, base, full, known = lm_words(r.text), 0.0, 0.0, 0
        for i, x in enumerate(w):
            c = grams[0][(x,)]
            known += c > 0
            p = (c + 0.1) / (tokens + 0.1 * (types + 1))
            base += math.log10(p)
            for n in (1, 2):
                if i >= n and total[n - 1][ctx := tuple(w[i - n : i])]:
                    t = total[n - 1][ctx]
                    p = max(grams[n][(*ctx, x)] - lm.DISCOUNT, 0) / t + lm.DISCOUNT * kinds[n - 1][ctx] / t * p
            full += math.log10(p)
        want[r.doc_id].append((len(w), known, tokens, base, full))
    assert len(out) == df.count()
    for r in out:
        assert any((r.n_tokens, r.n_known, r.train_tokens) == x[:3] and abs(r.base_score - x[3]) < 1e-6 * x[0] + 1e-9 and abs(r.score - x[4]) < 2e-4 * x[0] for x in want[r.doc_id])


def test_lm_probabilities_of_a_very_frequent_context_sum_to_one(tmp_path):
    n = np.array([10**9, *[1] * 3_000_000, *[5] * 1000, 6 * 10**9])
    kinds, total = len(n), int(n.sum())
    blob = lm.Level.build(np.zeros(kinds, np.uint64), np.arange(kinds, dtype=np.uint64), (n - lm.DISCOUNT) / total, kinds)
    (tmp_path / "level").write_bytes(blob)
    got = lm.restore(lm.Level(f"file://{tmp_path}/level", kinds).prob)
    assert np.allclose(got, (n - lm.DISCOUNT) / total, rtol=4e-4, atol=0)
    weight = lm.restore(lm.quantise(np.array([lm.DISCOUNT * kinds / total])))[0]
    assert abs(got.sum() + weight - 1) < 4e-4
    assert np.allclose(lm.restore(lm.quantise(np.array([0.25 / 2.0**63, 1.0]))), [0.25 / 2.0**63, 1.0], rtol=4e-4, atol=0)
    for wrong in (0.0, np.nan, 1.5):
        with pytest.raises(ValueError):
            lm.quantise(np.array([wrong]))


def test_lm_without_texts(spark):
    df = docs(spark, extra=False)
    model = lm.train(df.limit(0))
    assert model.tokens == 0 and lm.score(df, model).filter("n_known > 0").count() == 0
    assert lm.score(df.limit(0), lm.train(df)).count() == 0


# 7 -------------------------------------------------------------------------------------------------------------


def brute_components(rows, width, t):
    sets, up = [], {}
    for k, text in rows:
        w = lm_words(text)[:-1]
        sets.append((k, frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()))
        up[k] = k

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and len(a & b) * t.denominator >= t.numerator * len(a | b):
                p, q = root(sets[x][0]), root(sets[y][0])
                up[max(p, q)] = min(p, q)
    return {k: (len(s), root(k)) for k, s in sets}


def near_texts(n, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdef"), rng.integers(1, 4)))
    base, passage = [word() for _ in range(60)], " ".join(word() for _ in range(30))
    out = []
    for k in range(n):
        if k % 3 == 0:
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(0, len(w))] = word()
            out.append(" ".join(w))
        elif k % 3 == 1:
            out.append(passage + " " + " ".join(word() for _ in range(rng.integers(0, 8))))
        else:
            out.append(" ".join(word() for _ in range(rng.integers(0, 6))))
    return out


@pytest.mark.parametrize(("width", "t", "block"), [(3, Fraction(9, 10), 512), (3, Fraction(9, 10), 16), (5, Fraction(8, 10), 512)])
def test_jaccard_equals_brute_force(spark, monkeypatch, width, t, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = [*near_texts(240, 3), None, "", " \t", "One", "one", "one two", "ONE two", "one\x0btwo"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"key": F.lit("x"), "n": F.lit("y"), "component_id": F.lit("z")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, width=width, threshold=t).collect()}
    assert got == brute_components(list(enumerate(texts)), width, t)


def test_jaccard_many_near_copies(spark):
    """A hot group: 20,000 distinct near copies of one text, and as many texts that share nothing, in one class and alone."""
    base = F.lit(" ".join(f"w{k}" for k in range(60)))
    near = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(base, F.lit(" x"), F.col("id")).alias("text"))
    other = spark.range(20_000, 24_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"q{k}q"), "id") for k in range(12)]).alias("text"))
    out = jaccard.near_duplicates(near.unionByName(other))
    got = out.groupBy("component_id").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert sorted((r["count"], r.n) for r in got) == [(1, 4_000), (20_000, 1)]


def test_jaccard_rows_that_share_a_key(spark):
    w = [f"w{k}" for k in range(60)]
    z = [f"z{k}" for k in range(60)]
    rows = [(5, " ".join(w)), (5, " ".join(z)), (3, " ".join(z + ["more"])), (9, " ".join(w + ["more"])), (None, " ".join(w)), (5, " ".join(w))]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out if r.doc_id is not None) == [(3, 3), (5, 3), (5, 5), (5, 5), (9, 5)]


def test_words_of_any_length():
    long = "x" * 3_000_000
    for text in (long, f"a {long} b", f"{long} {long}y"):
        h, row = common.words(*common.text_bytes(pa.array([text, "a", long])))
        want = text.split() + ["a", long]
        assert len(h) == len(want) and len(set(h.tolist())) == len(set(want)) and row.tolist()[-2:] == [1, 2]


def test_jaccard_odd_rows(spark):
    df = docs(spark)
    out = jaccard.near_duplicates(df).collect()
    assert len(out) == df.count()
    assert {(r.doc_id, r.component_id) for r in out if r.doc_id is None} == {(None, None)}
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(8, 10), Fraction(1)])
def test_cells_admit_every_link(t):
    rng = np.random.default_rng(1)
    sets = []
    for size in (1, 5, 120, 255, 256, 300, 1000, 4100):
        base = rng.integers(0, 2**64, size, np.uint64)
        for change in (0, 1, size // 20, size // 9, size // 5):
            sets.append(np.unique(np.concatenate([base[change:], rng.integers(0, 2**64, int(rng.integers(0, change + 1)), np.uint64)])))
        sets.append(np.unique(rng.integers(0, 2**64, size, np.uint64)))
    n = np.array([len(x) for x in sets])
    cells = jaccard.cell_parities(np.concatenate(sets), n, t).to_pylist()
    i, j = np.triu_indices(len(sets), 1)
    p, q, apart = jaccard.admitted(cells, n, i, j, t)
    kept = dict(zip(zip(p.tolist(), q.tolist()), apart.tolist()))
    for x, y in zip(i.tolist(), j.tolist()):
        both = len(np.intersect1d(sets[x], sets[y]))
        if both >= t * (n[x] + n[y] - both):
            assert kept[x, y] <= n[x] + n[y] - 2 * both
    assert len(kept) < len(i) // 4


def test_forest_joins_what_the_pairs_join():
    rng = np.random.default_rng(0)
    for _ in range(100):
        m, e = int(rng.integers(2, 30)), int(rng.integers(0, 60))
        i, j, apart, part = rng.integers(0, m, e), rng.integers(0, m, e), rng.integers(0, 4, e), rng.integers(0, m, m)

        def classes(pairs, m=m, i=i, j=j, part=part):
            up = part.copy()
            for k in pairs:
                up[up == up[j[k]]] = up[i[k]]
            return [frozenset(np.flatnonzero(up == x)) for x in up]

        pick = jaccard.forest(m, i, j, apart, part)
        assert classes(pick) == classes(range(e))
        assert len(pick) == len(set(part)) - len(set(classes(range(e))))


# 8 -------------------------------------------------------------------------------------------------------------


def test_short_segments_are_padded():
    seg = langid.segments(np.frombuffer(b"abc", np.uint8), 6, 1)
    assert seg.shape == (1, langid.LENGTH) and (seg[0, 3:] == langid.PAD).all() and seg[0, :3].tolist() == [97, 98, 99]


def test_gradients_are_the_loss_slopes():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], 1, 4)
    net = langid.Network(net.langs, *[rng.standard_normal(p.shape) * 0.4 for p in net.params()])
    seg, want = rng.integers(0, 256, (3, 6)), np.array([0, 2, 1])
    seg[1, 3:] = langid.PAD
    _, grads = net.gradients(seg, want)
    for p, g in zip(net.params(), grads):
        at = np.unravel_index(np.abs(g).argmax(), p.shape)
        old, loss = p[at], []
        for e in (1e-3, -1e-3):
            p[at] = old + e
            loss.append(net.gradients(seg, want)[0])
        p[at] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - g[at]) < 1e-3 * abs(g[at]) + 1e-6


def test_langid_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op8_langid(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.97
    assert out.filter("score < 0 or score > 1 or lang_pred = 'und'").count() == 0


def test_langid_odd_rows(spark):
    df = docs(spark)
    net = langid.train(df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y")), steps=3)
    out = langid.identify(df, net).collect()
    assert len(out) == df.count()
    for r in out:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") is not letters and 0 <= r.score <= 1
    none = langid.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert none is None and {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), net).count() == 0


def test_langid_pooling_covers_every_byte():
    net = langid.Network.fresh(["a", "b"], 3)
    data = np.frombuffer(("abc def " * 40).encode(), np.uint8)
    offsets = np.array([0, 0, 7, 200, len(data)])
    got = net.documents(data, offsets)
    assert got[0].sum() == 0 and np.allclose(got[1:].sum(1), 1, atol=1e-5)
    parts = [net.labels(net.states(data[None, a : a + langid.LENGTH].astype(np.int64)))[:, 0] for a in range(200, len(data), langid.LENGTH)]
    assert np.allclose(got[3], np.concatenate(parts).mean(0), atol=1e-4)


# 9 -------------------------------------------------------------------------------------------------------------


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    wanted = keys.filter(F.crc32(F.col("key").cast("binary")) % 5 == 0)
    levels = urlfilter.cascade(keys.unionByName(keys), wanted.unionByName(spark.createDataFrame([(None,), ("elsewhere",)], "key string")), rate=0.2)
    assert len(levels) > 1
    rows = keys.groupBy(F.expr("cast(substr(key, 2) as long) % 50")).agg(F.collect_list("key").alias("ks"))
    out = urlfilter.mark(rows, "ks", levels, "hit").select(F.explode(F.arrays_zip("ks", "hit")).alias("x")).select("x.*")
    assert out.filter(F.col("hit") != (F.crc32(F.col("ks").cast("binary")) % 5 == 0)).count() == 0
    assert urlfilter.cascade(keys.limit(0), wanted) == []


URLS = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://Example.ORG/es/x?y#z", "https://a.example.org/en/12", "https://example.org/en/2", "http://xexample.org/es/", "http://a.com/fr/1", "http://com/de/", "http://a.com/de", "x://b.com/de/?q#f", "a://b://c.org/d", "http://é.com/fr/\nü"]


@pytest.mark.parametrize("bits", [1 << 27, 1])
def test_url_rules(spark, bits):
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    for r in urlfilter.judge(df, queries.URL_RULES, max_bits=bits).collect():
        u = r.url or ""
        rest = u.partition("://")[2]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *want[1:])
    assert urlfilter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_hosts_of_very_many_labels_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "com/fr/x"), (2, "http://example.org/es/"), (3, None), (4, "http://com.org.")], "page_id long, url string")
    assert {(r.page_id, r.rule, r.verdict) for r in urlfilter.judge(df, queries.URL_RULES).collect()} == {(1, "com/fr/", "allow"), (2, "example.org/es/", "block"), (3, None, "allow"), (4, None, "allow")}
    assert {(r.page_id, r.rule, r.verdict) for r in urlfilter.judge(df, []).collect()} == {(k, None, "allow") for k in (1, 2, 3, 4)}


def test_keys_that_share_their_hashes_are_joined(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "hashes", lambda key: (F.lit(7).cast("long"), F.length(key).cast("long")))
    monkeypatch.setattr(urlfilter, "LEVELS", 4)
    df = spark.createDataFrame([(1, "http://a.com/fr/x"), (2, "http://a.com/de/x"), (3, "http://a.com/xx/x"), (4, "http://b.example.org/es/")], "page_id long, url string")
    with pytest.raises(OverflowError):
        urlfilter.cascade(spark.createDataFrame([("ab",), ("ba",)], "key string"), spark.createDataFrame([("ab",)], "key string"))
    assert {(r.page_id, r.rule, r.verdict) for r in urlfilter.judge(df, queries.URL_RULES).collect()} == {(1, "com/fr/", "allow"), (2, "com/de/", "block"), (3, None, "allow"), (4, "example.org/es/", "block")}


# 10 ------------------------------------------------------------------------------------------------------------

LONG = "This sentence belongs to the article and is long enough to count as content, surely. " * 3
PAGES = [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words only", "plain words only"),
    (f"<nav><a>Home</a></nav><article><h1>T</h1><p>{LONG}<p>Be.</p><div class='ad'>Buy</div></article><footer>f</footer>", f"T {LONG}Be."),
    (f"<body><div id='menu'><ul><li><a>A</a><li><a>B</a></ul></div><div class=content><h1>T</h1><p>{LONG}</p><p>Fish &amp; chips&nbsp;x</p></div><div class='sidebar'>{LONG}</div></body>", f"T {LONG}Fish & chips x"),
    (f"<main><header><h1>T</h1></header><p>{LONG}</p><section class='comments'><p>{LONG}</p></section><form>f</form></main>", f"T {LONG}".strip()),
    (f"<article><p>wor<b>d</b> and<br>line{LONG}<script>var t='</p>';</script><style>p{{}}</style><!-- no --></article><div class=cookie-notice>c</div>", f"word and line{LONG}".strip()),
    (f"<div class=header>h</div><article><p>{LONG}</p><p>cut of", f"{LONG}cut of"),
    ("<article><p>" + "long " * 50_000 + "</p></article>", ("long " * 50_000).strip()),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert html.main_text(page) == " ".join(want.split())


WRAPPED = [
    (f"<div class='has-sidebar'><nav>n</nav><article><h1>T</h1><p>{LONG}</p></article></div><div class=footer>f</div>", f"T {LONG}"),
    (f"<div id='page' class='content with-sidebar'><h1>T</h1><p>{LONG}</p><p>Be.</p><div class=sidebar>{LONG}</div></div><div>Powered by it</div>", f"T {LONG}Be."),
    (f"<body><form id='aspnetForm'><div class=menu>m</div><div id=text><h1>T</h1><p>{LONG}</p></div></form></body>", f"T {LONG}"),
    (f"<div class='widget'><article><p>{LONG}</p></article></div><div class=sidebar>{LONG}{LONG}</div>", LONG),
    (f"<div class='post has-comments'><p>{LONG}</p><p>{LONG}</p><div id=comments><article>{LONG}</article></div></div>", LONG + LONG),
    (f"<article><p>{LONG}</p></article><div class=comments><article>{LONG}{LONG}</article></div><aside><article>{LONG}</article></aside>", LONG),
    (f"<main><p>{LONG}</p><div class='related-posts'><article>{LONG}{LONG}{LONG}</article></div></main>", LONG),
    (f"<div class=share-box><p>{LONG}</p><p>End.</p></div>", f"{LONG}End."),
    (f"<div class=sidebar><p>{LONG}{LONG}</p></div><div><p>{LONG}</p></div>", LONG),
]


@pytest.mark.parametrize(("page", "want"), WRAPPED)
def test_content_in_marked_holders(page, want):
    assert html.main_text(page) == " ".join(want.split())


BODY = f"<p>{LONG}</p>" * 4
PARTED = [
    (f"<body><div>Site</div><div id=content><h1>Title</h1><p>Intro</p><div class=body>{BODY}</div><p>End.</p></div></body>", f"Title Intro {LONG * 4}End."),
    (f"<body><div id=content><div><h1>Title</h1></div><p>By me</p><div class=body><div>{BODY}{BODY}</div><div><p>{LONG}</p></div></div></div><div class=footer>f</div></body>", f"Title By me {LONG * 9}"),
    (f"<body><h1>Title</h1><p>Intro</p><div>{BODY}</div></body>", f"Title Intro {LONG * 4}"),
    (f"<div id=page><div><h1>T</h1><p>Intro.</p><ul>{f'<li>{LONG}' * 6}</ul><p>End.</p></div></div>", f"T Intro. {LONG * 6}End."),
    (f"<div><h1>T</h1><p>Intro.</p><table>{f'<tr><td>{LONG}<td>1' * 6}</table></div>", f"T Intro. {f'{LONG} 1 ' * 6}"),
    (f"<div><article><h1>A</h1>{BODY}</article><article><h1>B</h1><p>{LONG}</p></article><article>Short.</article></div>", f"A {LONG * 4}B {LONG}Short."),
    (f"<main><h1>A</h1>{BODY}</main><article><p>{LONG}</p></article>", f"A {LONG * 4}"),
]


@pytest.mark.parametrize(("page", "want"), PARTED)
def test_content_in_parts(page, want):
    assert html.main_text(page) == " ".join(want.split())


DIVS = "".join(f"<div>{LONG}</div>" for _ in range(4))
BOUNDED = [
    (f"<body><div>nav one</div><div>Buy now cheap</div>{BODY}<div>(c) 2024 Company</div></body>", LONG * 4),
    (f"<body><div>Site</div><h1>Title</h1><div>By me</div>{BODY}<p>End.</p><div>(c) 2024</div><div>Powered by it</div></body>", f"Title By me {LONG * 4}End."),
    (f"<div id=x><div>one | two</div>{DIVS}<div>three</div></div>", LONG * 4),
    (f"<article><div>Short.</div>{DIVS}<div>End.</div></article>", f"Short. {LONG * 4}End."),
]


@pytest.mark.parametrize(("page", "want"), BOUNDED)
def test_density_bounds_the_text(page, want, monkeypatch):
    assert html.main_text(page) == " ".join(want.split())
    if "<article>" not in page:
        monkeypatch.setattr(html, "smoothed", lambda ratios: np.ones(len(ratios)))
        assert html.main_text(page) != " ".join(want.split())


ELEMENTS = [
    (f"<article><p class=ad>Buy</p><p>{LONG}</p><p hidden>no</p><p>a <span hidden>b</span>c</p><h2 class='share'>s</h2><li class=advert>t<li>u</li></article>", f"{LONG}a c u"),
    (f"<article><p hidden>no<p>{LONG}<p class='ad'>Buy<ul><li>one</ul></article>", f"{LONG}one"),
    (f"<article><p>{LONG}</p><button>b<p>c</article><p class=x>d</p>", LONG),
    (f"<article><div><select><option>o</div><p>{LONG}</p><div><svg><g><text>t</text></div><p>End.</p></article>", f"{LONG}End."),
    (f"<article><div><noscript><div>n</div><p>m</p></noscript>x</div><p>{LONG}</p></article>", f"x {LONG}"),
    (f"<article><p>{LONG}</p></article><footer>f</footer><a hr", LONG),
    (f"<article><p>{LONG}</p><p>cut <b", f"{LONG}cut"),
    ("1 < 2 and so on", "1 < 2 and so on"),
    (f"<article><p class='lead header'>{LONG}</p><input hidden><p>x</p></article>", f"{LONG}x"),
]


@pytest.mark.parametrize(("page", "want"), ELEMENTS)
def test_marks_of_any_element_and_unclosed_ones(page, want):
    assert html.main_text(page) == " ".join(want.split())


@pytest.mark.parametrize("part", ["<a ", "<div>", "<div>x", "<!--", "<div><h1>x", "<", "<button>", "<article>x</article>", "</", "<a b='", "<svg><g></q>", "<div></section>", "&"])
def test_hostile_pages_take_linear_time(part):
    def seconds(n):
        page = part * (n // len(part))
        began = time.process_time()
        html.main_text(page)
        return time.process_time() - began

    small, large = seconds(150_000), seconds(600_000)
    assert large < 8 * small + 0.5


def test_extract(spark):
    df = spark.createDataFrame([(k, "u", h, "mine") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got == {k: (t := " ".join(w.split()), len(t)) for k, (_, w) in enumerate(PAGES)}
    assert html.extract(df.limit(0)).count() == 0


def test_extract_query_equals_the_article(spark):
    import html as entities

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op10_html(spark, DATA).collect():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(entities.unescape(re.sub("<(?:/?p|br|/?h1)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == want and r.n_chars == len(want)
