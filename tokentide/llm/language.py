"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a window of bytes in both directions, a softmax over
their joint state labels every position, and a document's probabilities are the mean
over all its positions. Windows follow each other without gaps, so whole texts are
read; state starts anew in each window, in training as in prediction. The network is
trained in numpy by backpropagation through time.

It is fitted on a bounded sample: about ``TRAIN_DOCS`` documents with a language (never
more than twice as many), drawn by hashed id in equal shares for each language, a few
windows of each. A row is held
out, and never learned from, if crc32 of its doc_id as text is 2 modulo 4.

Defined cases: a null text or one without a letter is ``und`` with score 0; a null
doc_id is not held out and not learned from; without any language all rows are
``und``, with one only all with a letter are that one; repeated rows get a row each;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from ..session import staged
from .common import per_document, texts_of

UND = "und"
HIDDEN = 8
#: Bytes of a window, and windows that are read side by side.
WINDOW = 96
ABREAST = 2048
#: Documents to learn from, and windows of each.
TRAIN_DOCS = 2_000
TRAIN_WINDOWS = 3
STEPS = 450
BATCH = 96
SEED = 9

_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or bool(_LETTER.search(text.decode("utf-8", "replace")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def windows(texts: list[bytes], width: int = WINDOW):
    """Bytes of each window forwards and backwards (time by window), window lengths, and their text's number."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    counts = -(-lengths // width)
    owner = np.repeat(np.arange(len(texts)), counts)
    within = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * width
    begin = np.repeat(np.cumsum(lengths) - lengths, counts) + within
    size = np.minimum(width, np.repeat(lengths, counts) - within)
    buffer = np.frombuffer(b"".join(texts) + b"\0", dtype=np.uint8)
    t = np.arange(width)[:, None]
    valid = t < size
    last = len(buffer) - 1
    forth = np.where(valid, buffer[np.minimum(begin + t, last)], 0)
    back = np.where(valid, buffer[np.maximum(begin + size - 1 - t, 0)], 0)
    return np.stack((forth, back)), size, owner


@dataclass
class Network:
    """Weights; index 0 reads forwards, 1 backwards. Gates: update, reset, candidate."""

    table: np.ndarray  # (2, 256, 3H): input weights and biases by byte
    inner: np.ndarray  # (2, H, 3H)
    out: np.ndarray  # (2H, C)
    bias: np.ndarray  # (C,)

    @classmethod
    def fresh(cls, n_labels: int, hidden: int = HIDDEN) -> Network:
        random = np.random.default_rng(SEED)
        f = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 2 and shape[-2] < 256 else hidden)).astype(np.float32)
        return cls(0.5 * f(2, 256, 3 * hidden), f(2, hidden, 3 * hidden), f(2 * hidden, n_labels), np.zeros(n_labels, dtype=np.float32))

    def parts(self):
        return [self.table, self.inner, self.out, self.bias]

    def states(self, bytes_: np.ndarray, keep: bool = False):
        """Hidden states (time, direction, window, H); with ``keep`` also what backpropagation needs."""
        width, n, hidden = bytes_.shape[1], bytes_.shape[2], self.inner.shape[1]
        h = np.zeros((2, n, hidden), dtype=np.float32)
        made = np.empty((width, 2, n, hidden), dtype=np.float32)
        kept = []
        x = np.empty((2, n, 3 * hidden), dtype=np.float32)
        for t in range(width):
            for d in (0, 1):
                np.take(self.table[d], bytes_[d, t], axis=0, out=x[d])
            u = np.matmul(h, self.inner)
            gates = np.tanh(0.5 * (x[..., : 2 * hidden] + u[..., : 2 * hidden]))
            gates += 1
            gates *= 0.5
            z, r = gates[..., :hidden], gates[..., hidden:]
            c = np.tanh(x[..., 2 * hidden :] + r * u[..., 2 * hidden :])
            new = c + z * (h - c)
            if keep:
                kept.append((h, z, r, c, u[..., 2 * hidden :]))
            made[t] = h = new
        return (made, kept) if keep else made

    @staticmethod
    def aligned(back: np.ndarray, size: np.ndarray) -> np.ndarray:
        """States of the backward reader by position: time t stands for position size - 1 - t, and the other way round."""
        t = np.arange(len(back))[:, None]
        at = np.where(t < size, size - 1 - t, t)
        return back[at, np.arange(len(size))]

    def positions(self, bytes_: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Label probabilities of every position (time, window, label)."""
        made = self.states(bytes_)
        return _softmax(np.concatenate((made[:, 0], self.aligned(made[:, 1], size)), axis=-1) @ self.out + self.bias)

    def gradients(self, bytes_: np.ndarray, size: np.ndarray, label: np.ndarray):
        """Mean loss over positions and the gradient of each part, back through time."""
        hidden, width = self.inner.shape[1], bytes_.shape[1]
        made, kept = self.states(bytes_, keep=True)
        joint = np.concatenate((made[:, 0], self.aligned(made[:, 1], size)), axis=-1)
        p = _softmax(joint @ self.out + self.bias)
        valid = np.arange(width)[:, None] < size
        n = valid.sum()
        loss = -np.log(np.maximum(p[:, np.arange(len(label)), label], 1e-9))[valid].sum() / n
        p[:, np.arange(len(label)), label] -= 1
        p *= (valid / n)[..., None].astype(np.float32)
        d_out = np.tensordot(joint, p, axes=((0, 1), (0, 1)))
        d_joint = p @ self.out.T
        d_made = np.stack((d_joint[..., :hidden], self.aligned(d_joint[..., hidden:], size)), axis=1)
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        d_h = np.zeros_like(made[0])
        for t in reversed(range(width)):
            h, z, r, c, u = kept[t]
            d_h = d_h + d_made[t]
            d_c = d_h * (1 - z) * (1 - c * c)
            d_z = d_h * (h - c) * z * (1 - z)
            d_r = d_c * u * r * (1 - r)
            d_x = np.concatenate((d_z, d_r, d_c), axis=-1)
            d_u = np.concatenate((d_z, d_r, d_c * r), axis=-1)
            for d in (0, 1):
                np.add.at(d_table[d], bytes_[d, t], d_x[d])
            d_inner += np.matmul(h.transpose(0, 2, 1), d_u)
            d_h = d_h * z + np.matmul(d_u, self.inner.transpose(0, 2, 1))
        return loss, [d_table, d_inner, d_out, p.sum(axis=(0, 1))]

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the position probabilities of each text."""
        bytes_, size, owner = windows(texts)
        total = np.zeros((len(texts), len(self.bias)))
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), ABREAST):
            block = order[at : at + ABREAST]
            width = int(size[block[0]])
            p = self.positions(bytes_[:, :width, block], size[block])
            p *= (np.arange(width)[:, None] < size[block])[..., None]
            sums = p.sum(axis=0, dtype=np.float64)
            for k in range(sums.shape[1]):
                total[:, k] += np.bincount(owner[block], weights=sums[:, k], minlength=len(texts))
        return total / np.maximum(np.fromiter(map(len, texts), dtype=float, count=len(texts)), 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[bytes], labels: np.ndarray, n_labels: int, steps: int = STEPS, batch: int = BATCH) -> Network:
    """Adam over batches of windows, languages equally often."""
    network = Network.fresh(n_labels)
    random = np.random.default_rng(SEED)
    by_label = [np.flatnonzero(labels == k) for k in range(n_labels)]
    first = [np.zeros_like(p) for p in network.parts()]
    second = [np.zeros_like(p) for p in network.parts()]
    for step in range(1, steps + 1):
        label = np.arange(batch) % n_labels
        pick = [by_label[k][random.integers(len(by_label[k]))] for k in label]
        bytes_, size, owner = windows([texts[i] for i in pick])
        _, gradient = network.gradients(bytes_, size, label[owner])
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(network.parts(), gradient, first, second, strict=True):
            np.clip(g, -1, 1, out=g)
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= (rate / (1 - 0.9**step)) * a / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return network


def sample(docs: DataFrame) -> DataFrame:
    """(lang, text) windows of the documents to learn from; bounded by TRAIN_DOCS and TRAIN_WINDOWS.

    Every language gets an equal share: all of its documents if they are no more than
    that, else each by a hashed chance. So tasks hand on about TRAIN_DOCS rows together.
    """
    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and length(text) > 0").where(~held_out(F.col("doc_id")))
    n = staged(known.groupBy("lang").count(), "language-counts").withColumnRenamed("count", "n")
    share = max(1.0, TRAIN_DOCS / max(1, n.count()))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40) * F.col("n")
    place = lambda i: F.pmod(F.xxhash64("doc_id", i), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(1), F.lit(TRAIN_WINDOWS)), lambda i: F.substr(F.col("text"), place(i), F.lit(WINDOW // 2 + 16)))
    drawn = known.join(n, "lang").withColumn("rank", rank).where(F.col("rank") < share).select("lang", "rank", "doc_id", cut.alias("cut"))
    return drawn.orderBy("rank", "doc_id", "cut").limit(2 * TRAIN_DOCS).select("lang", F.explode("cut").alias("text"))


def fit(docs: DataFrame) -> tuple[list[str], Network | None]:
    """Languages in order, and the network (none for fewer than two languages)."""
    rows = [(r.lang, r.text.encode()) for r in sample(docs).collect()]
    rows = sorted((lang, text[:WINDOW]) for lang, text in rows if text)
    languages = sorted({lang for lang, _ in rows})
    if len(languages) < 2:
        return languages, None
    number = {lang: k for k, lang in enumerate(languages)}
    return languages, train([t for _, t in rows], np.array([number[lang] for lang, _ in rows]), len(languages))


def identify(docs: DataFrame, model: tuple[list[str], Network | None]) -> DataFrame:
    """doc_id, held_out, lang_pred and score (its probability) of every row of ``docs``; only text decides."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [StructField("lang_pred", StringType(), False), StructField("score", DoubleType(), False)]

    def start():
        languages, network = sent.value

        def score(batch):
            texts = texts_of(batch)
            letters = [has_letter(t) and bool(languages) for t in texts]
            p = network.document_probabilities(texts) if network else np.ones((len(texts), 1))
            best = p.argmax(axis=1)
            top = np.clip(p[np.arange(len(texts)), best], 0, 1)
            return [[languages[b] if a else UND for a, b in zip(letters, best.tolist(), strict=True)], np.where(letters, top, 0.0)]

        return score

    made = per_document(docs, fields, start)
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
