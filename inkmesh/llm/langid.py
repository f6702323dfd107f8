"""Operator 8: language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of ``LENGTH`` bytes. One recurrent network reads each segment forwards,
another backwards; their states at a byte give that byte's language probabilities, and a document's
are the mean over all its bytes. Training is backpropagation through time in numpy on a bounded
sample of labelled segments; applying the network is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _extended, _kept
from .common import give_back, mix64, slices, text_bytes

LENGTH, HIDDEN, PAD = 64, 16, 256
#: Bounds of the training sample: documents of each language, and segments of each document.
PER_LANGUAGE, SEGMENTS = 600, 6


def _squash(x: np.ndarray, room: np.ndarray) -> None:
    """``x / (1 + |x|)`` in place, by way of ``room``: from -1 to 1, as a gate needs, without an exponential."""
    np.abs(x, out=room)
    room += 1
    x /= room


def _slope(s: np.ndarray) -> np.ndarray:
    """Slope of the squashing function, from its value."""
    return np.square(1 - np.abs(s))


@dataclass
class Network:
    """Direction first: 0 reads forwards, 1 backwards. Gates in the order update, reset, candidate."""

    langs: list[str]
    x: np.ndarray  # (2, 257, 3H) input weights by byte, biases included
    u: np.ndarray  # (2, H, 3H) recurrent weights
    v: np.ndarray  # (2, H, C) output weights
    c: np.ndarray  # (C,)

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 1, hidden: int = HIDDEN) -> "Network":
        rng = np.random.default_rng(seed)
        make = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        return cls(langs, make(2, 257, 3 * hidden, scale=0.3), make(2, hidden, 3 * hidden, scale=hidden**-0.5), make(2, hidden, len(langs), scale=0.3), np.zeros(len(langs), np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.v, self.c]

    def states(self, seg: np.ndarray, keep: bool = False):
        """Hidden states (2, L, B, H) at each byte of ``seg`` (B, L); with ``keep`` the gates too.

        Padding has an update gate of exactly 1, so it leaves the state as it is.
        """
        b, n = seg.shape
        k, kind = self.u.shape[1], self.x.dtype
        both = np.ascontiguousarray(np.stack([seg.T, seg.T[::-1]]), np.intp)  # (2, L, B)
        x_gate, x_cand = self.x[..., : 2 * k].copy(), self.x[..., 2 * k :].copy()
        x_gate[:, PAD, :k] = 1e30
        u_gate, u_cand = self.u[..., : 2 * k].copy(), self.u[..., 2 * k :].copy()
        h, out, kept = np.zeros((2, b, k), kind), np.empty((2, n, b, k), kind), []
        gate, cand, own_gate, own_cand = (np.empty((2, b, m), kind) for m in (2 * k, k, 2 * k, k))
        for t in range(n):
            for d in (0, 1):
                np.take(x_gate[d], both[d, t], 0, out=own_gate[d], mode="clip")
                np.take(x_cand[d], both[d, t], 0, out=own_cand[d], mode="clip")
            np.matmul(h, u_gate, out=gate)
            np.matmul(h, u_cand, out=cand)
            gate += own_gate
            _squash(gate, own_gate)
            gate *= 0.5
            gate += 0.5
            z, r = gate[..., :k], gate[..., k:]
            if keep:
                kept.append([h.copy(), z.copy(), r.copy(), cand.copy()])
            cand *= r
            cand += own_cand
            _squash(cand, own_cand)
            if keep:
                kept[-1].append(cand.copy())
            h -= cand
            h *= z
            h += cand
            out[0, t], out[1, n - 1 - t] = h[0], h[1]
        return (out, both, kept) if keep else out

    def labels(self, out: np.ndarray) -> np.ndarray:
        """Language probabilities (L, B, C) of each byte."""
        _, n, b, k = out.shape
        s = self.v[0].T @ out[0].reshape(-1, k).T
        s += self.v[1].T @ out[1].reshape(-1, k).T
        s += self.c[:, None]
        s -= s.max(0)
        np.exp(s, out=s)
        s /= s.sum(0)
        return s.T.reshape(n, b, -1)

    def gradients(self, seg: np.ndarray, want: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the bytes that are not padding, and its gradients, by backpropagation through time."""
        out, both, kept = self.states(seg, keep=True)
        p = self.labels(out)
        real = (seg.T != PAD)[..., None]
        total = max(1, int(real.sum()))
        rows = np.arange(len(want))
        loss = float(-(np.log(p[:, rows, want] + 1e-9) * real[..., 0]).sum() / total)
        d = p.copy()
        d[:, rows, want] -= 1
        d *= real / total
        dv = np.stack([np.einsum("lbh,lbc->hc", out[k], d) for k in (0, 1)])
        dc = d.sum((0, 1))
        dout = np.stack([d @ self.v[0].T, (d @ self.v[1].T)[::-1]])  # in reading order
        dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
        dh = np.zeros_like(kept[0][0])
        each = np.empty((2, *both.shape[1:], self.x.shape[-1]), self.x.dtype)
        for t in range(seg.shape[1] - 1, -1, -1):
            h, z, r, gn, cand = kept[t]
            dh = dh + dout[:, t]
            dcand = dh * (1 - z) * _slope(cand)
            dz = dh * (h - cand) * 0.5 * _slope(2 * z - 1)
            dr = dcand * gn * 0.5 * _slope(2 * r - 1)
            dg = np.concatenate([dz, dr, dcand * r], -1)
            each[:, t] = np.concatenate([dz, dr, dcand], -1)
            du += np.matmul(h.transpose(0, 2, 1), dg)
            dh = dh * z + np.matmul(dg, self.u.transpose(0, 2, 1))
        for k in (0, 1):  # sums by byte
            byte = both[k].ravel()
            order = np.argsort(byte, kind="stable")
            first = np.flatnonzero(np.diff(byte[order], prepend=-1))
            dx[k, byte[order[first]]] = np.add.reduceat(each[k].reshape(len(byte), -1)[order], first)
        dx[:, PAD] = 0
        return loss, [dx, du, dv, dc]

    def fit(self, seg: np.ndarray, want: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 2) -> list[float]:
        """Adam with a falling rate."""
        rng, losses = np.random.default_rng(seed), []
        m, s = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(seg), min(batch, len(seg)))
            loss, grads = self.gradients(seg[pick], want[pick])
            losses.append(loss)
            lr = rate * (1 - 0.95 * step / steps)
            for p, g, a, b in zip(self.params(), grads, m, s):
                np.clip(g, -1, 1, out=g)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def documents(self, data: np.ndarray, offsets: np.ndarray, block: int = 1536) -> np.ndarray:
        """Mean probabilities (documents, C) over all bytes of each text; zeros for empty texts."""
        size = np.diff(offsets)
        n = -(-size // LENGTH)
        doc = np.repeat(np.arange(len(size)), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = offsets[:-1][doc] + nth * LENGTH
        length = np.minimum(LENGTH, offsets[1:][doc] - start)
        total = np.zeros((len(size), len(self.langs)))
        span = np.arange(LENGTH)
        order = np.argsort(-length, kind="stable")  # short last segments together
        for a in range(0, len(doc), block):
            own = order[a : a + block]
            width = int(length[own].max())
            at = start[own][:, None] + span[:width]
            real = span[:width] < length[own][:, None]
            seg = np.where(real, data[np.minimum(at, len(data) - 1)].astype(np.int64), PAD)
            p = (self.labels(self.states(seg)) * real.T[..., None]).sum(0)
            np.add.at(total, doc[own], p)
        return total / np.maximum(size, 1)[:, None]


def segments(data: np.ndarray, most: int, seed: int) -> np.ndarray:
    """At most ``most`` segments of one text, from places that ``seed`` decides.

    Every other one is cut short, as whole texts and last segments can be; short ones are padded.
    """
    n = max(1, min(most, len(data) // LENGTH))
    h = mix64(np.arange(2 * n, dtype=np.uint64) + np.uint64(seed & (2**64 - 1)))
    length = np.where(np.arange(n) % 2 == 0, LENGTH, 6 + (h[n:] % np.uint64(LENGTH - 5)).astype(np.int64))
    at = (h[:n] % np.uint64(max(0, len(data) - LENGTH) + 1)).astype(np.int64)
    at[length < LENGTH // 2] = 0  # short texts begin a sentence
    place = at[:, None] + np.arange(LENGTH)
    real = (np.arange(LENGTH) < length[:, None]) & (place < len(data))
    return np.where(real, data[np.minimum(place, len(data) - 1)].astype(np.int64), PAD)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, per_document: int = SEGMENTS, steps: int = 400, seed: int = 1) -> Network | None:
    """A network for the languages of ``labelled``; None if no row has both a text with bytes and a language.

    The sample is a documented bound: at most ``per_language`` documents of each language, those with the smallest hashes of
    key and text (rows that repeat both count once), and ``per_document`` segments of each, cut by the executors. The driver
    thus gets ``per_language * per_document * LENGTH`` bytes at most for each language whatever the table holds, and trains
    on them.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(seed), key, text).alias("h"))
    counts = rows.groupBy("lang").count()
    # a few more than wanted are drawn by hash, by the whole range of the hash; the bound is kept exactly after that
    shares = {r["lang"]: min(1.0, 1.25 * (per_language + 40) / r["count"]) for r in counts.collect()}
    if not shares:
        return None
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    picked = rows.filter(F.shiftrightunsigned("h", 1) <= F.element_at(share, F.col("lang")) * float(1 << 63))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            names, hashes = batch.column(0), batch.column(2)
            out = [segments(np.frombuffer(t.encode(), np.uint8), per_document, h).astype("<u2").tobytes() for t, h in zip(batch.column(1).to_pylist(), hashes.to_pylist())]
            yield pa.RecordBatch.from_arrays([names, hashes, pa.array(out, pa.binary())], ["lang", "h", "segs"])

    drawn = picked.mapInArrow(cut, "lang string, h long, segs binary").dropDuplicates(["lang", "h"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h"))
    sample = sorted((r.lang, r.h, bytes(r.segs)) for r in drawn.withColumn("nth", nth).filter(F.col("nth") <= per_language).collect())
    if not sample:
        return None
    size = 2 * LENGTH
    sample = [(name, h, segs[a : a + size]) for name, h, segs in sample for a in range(0, len(segs), size)]
    langs = sorted({name for name, _, _ in sample})
    seg = np.frombuffer(b"".join(s for _, _, s in sample), "<u2").reshape(-1, LENGTH).astype(np.int64)
    want = np.array([langs.index(name) for name, _, _ in sample])
    each = [np.flatnonzero(want == k) for k in range(len(langs))]  # languages weigh alike
    even = np.concatenate([np.resize(x, max(map(len, each))) for x in each])
    net = Network.fresh(langs, seed)
    net.fit(seg[even], want[even], steps)
    return net


def identify(df: DataFrame, net: Network | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language of each whole text and its pooled probability; one narrow stage.

    Null texts and texts without a letter, and all texts if there is no network, are ``und`` with score 0. Ties go to
    the language first in the alphabet. Columns with the added names are replaced; only the text is an input.
    """
    spark = df.sparkSession
    flag = "_li_letter"
    rows = df.withColumn(flag, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = _extended(df, [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    names = [f.name for f in schema.fields]
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = shared.value
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
                known = batch.column(batch.schema.get_field_index(flag)).to_numpy(zero_copy_only=False).astype(bool)
                if own is None:
                    best, top = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                else:
                    p = own.documents(data, offsets)
                    best = [own.langs[k] if ok else "und" for k, ok in zip(p.argmax(1), known)]
                    top = np.where(known, np.clip(p.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(_kept(batch, schema, 2) + [pa.array(best), pa.array(top)], names)

    return rows.mapInArrow(run, schema)


def remainder(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))
