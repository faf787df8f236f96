"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The network reads windows of `WINDOW` bytes from both ends, labels every byte position with language
probabilities, and a document's probabilities are the mean over all its positions. It is trained here by backpropagation through
time on windows at hashed offsets of a bounded number of labelled documents of each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import checkpointed
from .common import as_bytes, slices

WINDOW, HIDDEN = 64, 6
#: Languages up to which their shares are broadcast; beyond it, Spark deals out the join.
BROADCAST_LANGUAGES = 10_000
UNDETERMINED = "und"


def has_letter(text: str | None) -> bool:
    """Whether a character of the Unicode categories L is in it: digits, fractions, circled and Roman numerals are none."""
    return any(map(str.isalpha, text or ""))


class GatedNetwork:
    """Arrays have the direction first: 0 reads forwards, 1 backwards. Gates: update, reset, candidate."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {
            "byte": rng.normal(0, 0.3, (2, 256, 3 * hidden)), "state": rng.normal(0, 0.5 / hidden**0.5, (2, hidden, 3 * hidden)),
            "out": rng.normal(0, 0.5, (2 * hidden, classes)), "bias": np.zeros(classes),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(T, B, 2H) hidden states of byte windows x (B, T); keep gets what the backward pass needs."""
        b, t, h = x.shape[0], x.shape[1], self.h
        table, state = self.p["byte"], self.p["state"]
        out = np.empty((t, b, 2 * h), dtype=np.float32)
        s = np.zeros((2, b, h), dtype=np.float32)
        for k in range(t):
            a = np.matmul(s, state)
            e = np.stack([table[0][x[:, k]], table[1][x[:, t - 1 - k]]])
            gate = np.tanh(0.5 * (e[..., : 2 * h] + a[..., : 2 * h]))
            gate += 1
            gate *= 0.5
            z, r = gate[..., :h], gate[..., h:]
            cand = np.tanh(e[..., 2 * h :] + r * a[..., 2 * h :])
            new = cand + z * (s - cand)
            if keep is not None:
                keep.append((s, z, r, cand, a[..., 2 * h :]))
            s = new
            out[k, :, :h] = s[0]
            out[t - 1 - k, :, h:] = s[1]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, classes, B): of each position. The forward pass of states() with windows last, so that all gates are contiguous."""
        b, t, h = x.shape[0], x.shape[1], self.h
        half = np.repeat(np.float32([0.5, 0.5, 1]), h)[:, None]  # a sigmoid is a tanh of half its argument
        table = np.ascontiguousarray(self.p["byte"].transpose(0, 2, 1) * half)
        turned = np.ascontiguousarray(self.p["state"].transpose(0, 2, 1) * half)
        out = np.ascontiguousarray(self.p["out"].T)
        x = np.ascontiguousarray(x.T).astype(np.intp)
        e, a, s = np.empty((2, 3 * h, b), np.float32), np.empty((2, 3 * h, b), np.float32), np.zeros((2, h, b), np.float32)
        logits = np.zeros((t, len(out), b), dtype=np.float32)
        logits += self.p["bias"][:, None]
        for k in range(t):
            np.take(table[0], x[k], axis=1, out=e[0], mode="clip")
            np.take(table[1], x[t - 1 - k], axis=1, out=e[1], mode="clip")
            np.matmul(turned, s, out=a)
            gate = e[:, : 2 * h] + a[:, : 2 * h]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            cand = a[:, 2 * h :]
            cand *= gate[:, h:]
            cand += e[:, 2 * h :]
            np.tanh(cand, out=cand)
            s -= cand
            s *= gate[:, :h]
            s += cand
            logits[k] += out[:, :h] @ s[0]
            logits[t - 1 - k] += out[:, h:] @ s[1]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
        b, t, h = x.shape[0], x.shape[1], self.h
        keep: list = []
        hs = self.states(x, keep)
        logits = hs @ self.p["out"] + self.p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        loss = float(-np.log(prob[:, np.arange(b), y] + 1e-9).mean())
        d = prob
        d[:, np.arange(b), y] -= 1
        d /= b * t
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = np.einsum("tbh,tbc->hc", hs, d)
        g["bias"] = d.sum(axis=(0, 1))
        dh = d @ self.p["out"].T
        back = np.zeros((2, b, h), dtype=np.float32)
        turned = self.p["state"].transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            s, z, r, cand, an = keep[k]
            back = back + np.stack([dh[k, :, :h], dh[t - 1 - k, :, h:]])
            dcand = back * (1 - z) * (1 - cand * cand)
            dz = back * (s - cand) * z * (1 - z)
            dr = dcand * an * r * (1 - r)
            de = np.concatenate([dz, dr, dcand], axis=2)
            da = np.concatenate([dz, dr, dcand * r], axis=2)
            g["state"] += np.matmul(s.transpose(0, 2, 1), da)
            for i, at in ((0, k), (1, t - 1 - k)):
                order = np.argsort(x[:, at], kind="stable")
                key = x[order, at]
                cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                g["byte"][i][key[cut]] += np.add.reduceat(de[i][order], cut, axis=0)
            back = back * z + np.matmul(da, turned)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 192, rate: float = 0.02, seed: int = 7) -> GatedNetwork:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for n in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(batch, len(x)))
            _, g = self.gradients(x[pick], y[pick])
            size = sum(float((v * v).sum()) for v in g.values()) ** 0.5
            now = rate * min(1.0, 2 * (1 - n / (steps + 1)))
            for k, v in g.items():
                v *= min(1.0, 1.0 / (size + 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= now * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
        return self


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows (N, WINDOW), first position that counts, document) of all bytes of the texts.

    The last window of a text ends with it, and counts from where the one before ended; shorter texts are padded by bytes 0, which
    count as positions only of texts without a byte.
    """
    flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), dtype=np.uint8)
    size = np.array([len(t) for t in texts])
    n = np.maximum(1, -(-size // WINDOW))
    doc = np.repeat(np.arange(len(texts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.minimum(k * WINDOW, np.maximum(size[doc] - WINDOW, 0))
    at = begin[:, None] + np.arange(WINDOW)
    x = flat[(np.cumsum(size) - size)[doc][:, None] + np.minimum(at, np.maximum(size[doc] - 1, 0)[:, None])]
    x = np.where(at < size[doc][:, None], x, 0).astype(np.uint8)
    return x, k * WINDOW - begin, doc


def predict(net: GatedNetwork, texts: list[bytes], most: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(mean probabilities, positions labelled with each class) per text; whole texts."""
    classes = len(net.p["bias"])
    total, labelled = np.zeros((len(texts), classes)), np.zeros((len(texts), classes), dtype=np.int64)
    x, skip, doc = windows_of(texts)
    size = np.array([len(t) for t in texts])
    place = np.arange(WINDOW)
    for a in range(0, len(x), most):
        part, d = x[a : a + most], doc[a : a + most]
        prob = net.probabilities(part)
        counts = (place[:, None] >= skip[a : a + most]) & (place[:, None] < np.maximum(size[d], 1))
        best = prob.max(axis=1)
        if not counts.all():
            prob *= counts[:, None]
            best = np.where(counts, best, 2)
        pooled = prob.sum(axis=0).T
        marks = np.stack([(prob[:, c] == best).sum(axis=0) for c in range(classes)], axis=1)
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        total[d[cut]] += np.add.reduceat(pooled, cut, axis=0)
        labelled[d[cut]] += np.add.reduceat(marks, cut, axis=0)
    return total / np.maximum(size, 1)[:, None], labelled


def train(labelled: DataFrame, per_language: int = 400, windows: int = 4, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> tuple[list[str], GatedNetwork | None]:
    """Languages in order, and a network over them, from about per_language documents of each language and `windows` windows of each.

    With many languages fewer are taken of each, so that about `most` windows in all come to the driver: the bound of the sample. With more languages
    than that, languages none of whose documents are drawn are not learned. Documents are taken by hash of their id, so the sample is the same at any partitioning. Rows with a null id, text or language are left
    out. Without labelled rows there are no languages and no network.
    """
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    counted = checkpointed(rows.groupBy("lang").agg(F.count("*").alias("n")))
    n_langs = counted.count()
    each = min(float(per_language), most / (windows * max(1, n_langs)))
    share = counted.select("lang", (F.lit(each) / F.col("n")).alias("share"))
    share = F.broadcast(share) if n_langs <= BROADCAST_LANGUAGES else share
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    raw = F.encode("text", "UTF-8")
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.substr("raw", (F.pmod(F.xxhash64("doc_id", k), F.greatest(F.length("raw") - WINDOW + 1, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)))
    picked = rows.join(share, "lang").where(draw < F.col("share")).withColumn("raw", raw).select("doc_id", "lang", cut.alias("cut")).orderBy("doc_id", "lang").collect()
    langs = sorted({r["lang"] for r in picked})
    if not langs:
        return [], None
    x = np.zeros((len(picked) * windows, WINDOW), dtype=np.uint8)
    for i, piece in enumerate(p for r in picked for p in r["cut"]):
        x[i, : len(piece)] = np.frombuffer(bytes(piece), dtype=np.uint8)
    y = np.repeat([langs.index(r["lang"]) for r in picked], windows)
    return langs, GatedNetwork(len(langs)).fit(x, y, **options)


def identify(docs: DataFrame, langs: list[str], net: GatedNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_positions map<string, long>): one row per row of docs.

    Null texts, texts without a letter, and any text without a trained network, are `und` with score 0. n_positions has the
    positions labelled with each language. Repeated rows and null ids keep their rows; an empty table gives no rows. Texts are read whole, however
    long; of equally likely languages the first in order counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = as_bytes(b.column(1))
            lettered = [has_letter(t) for t in b.column(1).to_pylist()]
            if net is None:
                names, score, marks = [UNDETERMINED] * len(raw), np.zeros(len(raw)), np.zeros((len(raw), 0), dtype=np.int64)
            else:
                prob, marks = predict(net, [t or b"" for t in raw])
                best = prob.argmax(axis=1)
                names = [langs[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), lettered, strict=True)]
                score = np.where(lettered, np.clip(prob[np.arange(len(raw)), best], 0, 1), 0.0)
            offsets = np.arange(len(raw) + 1) * len(langs)
            maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(langs * len(raw), pa.string()), pa.array(marks.reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(names), pa.array(score), maps], ["doc_id", "lang_pred", "score", "n_positions"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, n_positions map<string,bigint>")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
