"""Byte-level BPE against the tiktoken library: every code point, odd texts, offsets, the query."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from inkmesh.llm import bytebpe, queries

from ..conftest import DATA
from .test_operators import docs

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as _f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _f)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(raw):
    return np.frombuffer(bytes(raw), "<u4").tolist()


def agree(texts):
    coder = bytebpe.ByteBpe.load(PATH)
    for text, (raw, ends) in zip(texts, coder.encode(pa.array(texts, pa.string()))):
        want = LIBRARY.encode_ordinary(text)
        assert ids(raw) == want
        assert ids(ends) == np.cumsum([len(LIBRARY.decode_single_token_bytes(t)) for t in want]).tolist()
        assert coder.decode(raw, ends) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("'strevmld  \n\t\x85　aZé日1٣!-😀\x1cⅷ́"), max_size=60), max_size=4))
def test_equals_the_library(texts):
    agree(texts)


def test_every_code_point_has_the_library_s_class():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    agree(["".join(f"a{chr(c)}1{chr(c)} " for c in points[a : a + 20_000]) for a in range(0, len(points), 20_000)])


def test_long_pieces_and_texts():
    agree(["x" * 5000, "ab" * 4000, " " * 3000, "'" * 50, "a" * 300 + " b", "", "\n", " 's's 'll 've'", "word " * 20_000])


def test_scan_equals_one_step_after_another():
    s, rng = bytebpe.Splitter(), np.random.default_rng(3)
    functions = np.concatenate([s.of_kind, s.of_first])[rng.integers(0, 14, 70_000)]
    state, want = bytebpe.START, []
    for f in functions.tolist():
        state = int(s.maps[f, state])
        want.append(state)
    for width in (2, 7, 256):
        assert s.maps[s.scan(functions[: 900 if width == 2 else None], width), bytebpe.START].tolist() == want[: 900 if width == 2 else None]


def test_cache_of_few_bytes(monkeypatch):
    random.seed(2)
    texts = ["".join(random.choice("abcdé 1") for _ in range(400)) for _ in range(20)] + ["y" * 400]
    small = bytebpe.ByteBpe(PATH)
    for limit, longest in ((0, 256), (3000, 3), (1 << 20, 3)):
        monkeypatch.setattr(bytebpe, "CACHE_BYTES", limit)
        monkeypatch.setattr(bytebpe, "CACHED", longest)
        for t in texts:
            assert ids(small.encode(pa.array([t]))[0][0]) == LIBRARY.encode_ordinary(t)
            assert small.held <= limit and all(len(p) <= 256 for p in small.chunks)


def test_runs_of_tokens_decode_at_their_place():
    coder, text = bytebpe.ByteBpe.load(PATH), "Größe, 日本 and more"
    raw, ends = coder.encode(pa.array([text]))[0]
    at = [0, *ids(ends)]
    for a in range(len(at) - 1):
        for b in range(a + 1, len(at)):
            assert coder.decode(raw[4 * a : 4 * b], ends[4 * a : 4 * b]) == text.encode()[at[a] : at[b]]
    with pytest.raises(ValueError):
        coder.decode(raw, ends[4:] + ends[:4])


def test_odd_rows(spark):
    df = docs(spark)
    out = bytebpe.encode(df, PATH, ends="N", decoded="key")
    assert sorted(out.columns) == sorted({*df.columns, "n_tokens"})
    for r in out.collect():
        want = LIBRARY.encode_ordinary(r.text or "")
        assert ids(r.ids) == want and r.n_tokens == len(want) == len(ids(r.N)) and bytes(r.key) == (r.text or "").encode()
    back = bytebpe.decode(out.drop("key"), PATH, ends="N").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back) and len(back) == df.count()
    assert bytebpe.encode(df.limit(0), PATH).count() == 0 == bytebpe.decode(out.limit(0), PATH).count()


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = queries.op11_bytebpe(spark, DATA).collect()
    assert len(out) == len(texts)
    for r in out:
        want = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
