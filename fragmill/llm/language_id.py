"""Language identification by a byte convolutional network: filters of several widths over embedded bytes, max pooling over a
window and softmax, trained in numpy on labelled text and applied to batched windows of fixed length.

The classifier is fitted on a bounded sample of labelled rows (about max_docs_per_label rows of every label, four windows of
each); prediction reads every text whole, as consecutive windows whose probabilities are averaged by their
length in bytes.

Because a filter is a sum over its bytes, its response to a pair of bytes is looked up in a table of 65,536 rows, so a
window costs two table reads per byte.

Edge cases: a null text, and one without a letter, is ``und`` with score 0; so is every text if no label was learned; texts
shorter than a window are padded with zero bytes; repeated rows are predicted alike; an empty table gives no rows; input
columns named like an output column are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import by_bytes
from .token_memo import forget

WINDOW, WIDTHS, FILTERS, DIMENSION = 256, (2, 3, 4), 12, 16
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text leaves 1 when divided by 3; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_windows(docs: DataFrame, max_docs_per_label: int = 1000) -> dict[str, list[str]]:
    """Windows of text by label, from a sample of docs that is drawn by hashes: about max_docs_per_label of each label, and no
    more than twice as many rows in all."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(2**40)) / 2**40
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, max_docs_per_label / n)))
    sample = labelled.where(draw < F.try_element_at(share, F.col("lang"))).select("doc_id", "lang", "text", draw.alias("draw"))
    length = F.greatest(F.length("text") - WINDOW, F.lit(1))
    cuts = F.array(*(F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), length) + 1).cast("int"), F.lit(WINDOW)) for k in range(4)))
    out: dict[str, list[str]] = {}
    few = sample.select("lang", cuts.alias("cuts"), "draw", "doc_id").orderBy("draw", "doc_id", "lang", "cuts").limit(2 * max_docs_per_label * len(counts))
    for row in few.collect():
        out.setdefault(row["lang"], []).extend(row["cuts"])
    return {lang: out[lang] for lang in sorted(out)}


class ByteCnn:
    """The network's weights: byte embeddings, one filter bank per width, and the dense layer."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embedding = rng.normal(0, 0.5, (256, DIMENSION)).astype(np.float32)
        self.banks = [rng.normal(0, (w * DIMENSION) ** -0.5, (w, DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.banks, self.dense, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross entropy of windows x with labels y, and its gradients by the weights."""
        pooled, where = [], []
        for w, bank in zip(WIDTHS, self.banks, strict=True):
            n = WINDOW - w + 1
            out = sum((self.embedding @ bank[j])[x[:, j : j + n]] for j in range(w))
            where.append(out.argmax(1))
            pooled.append(np.take_along_axis(out, where[-1][:, None, :], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        active = np.maximum(h, 0)
        p = _softmax(active @ self.dense + self.bias)
        loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-30)).mean())
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        g_h = (p @ self.dense.T) * (h > 0)
        grads = [np.zeros_like(self.embedding), *(np.zeros_like(b) for b in self.banks), active.T @ p, p.sum(0)]
        for i, (w, bank) in enumerate(zip(WIDTHS, self.banks, strict=True)):
            g = g_h[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                byte = np.take_along_axis(x, where[i] + j, 1)
                table = np.zeros((256, FILTERS), dtype=g.dtype)
                np.add.at(table, (byte, np.arange(FILTERS)[None, :]), g)
                grads[0] += table @ bank[j].T
                grads[1 + i][j] = self.embedding.T @ table
        return loss, grads

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 7) -> ByteCnn:
        """Adam on the cross entropy.  Only the windows' maxima carry gradients back to the filters and embeddings."""
        rng = np.random.default_rng(seed)
        weights = self.weights()
        first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                grads = self.gradients(windows[order[at : at + batch]], target[order[at : at + batch]])[1]
                t += 1
                step = rate * (1 - epoch / epochs)
                for w, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to a pair of bytes: of all filters to their first two bytes, and of the wider ones to the pair after."""
        t = [[self.embedding @ bank[j] for j in range(w)] for w, bank in zip(WIDTHS, self.banks, strict=True)]

        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)

        ahead = np.concatenate([pair(x[0], x[1]) for x in t], 1)
        beyond = np.concatenate([pair(t[1][2], np.zeros_like(t[1][2])), pair(t[2][2], t[2][3])], 1)
        return np.ascontiguousarray(ahead), np.ascontiguousarray(beyond)

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Label probabilities of each window, 64 windows at a time."""
        ahead, beyond = tables
        out = np.empty((len(windows), len(self.labels)), dtype=np.float32)
        for at in range(0, len(windows), 64):
            x = windows[at : at + 64].astype(np.intp)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            n = WINDOW - 3
            response = ahead[pairs[:, :n]]
            response[:, :, FILTERS:] += beyond[pairs[:, 2 : 2 + n]]
            pooled = response.max(1)
            # the last places of the narrower filters
            pooled[:, :FILTERS] = np.maximum(pooled[:, :FILTERS], ahead[pairs[:, n:]][:, :, :FILTERS].max(1))
            last = ahead[pairs[:, n]][:, FILTERS : 2 * FILTERS] + beyond[x[:, -1] * 256][:, :FILTERS]
            pooled[:, FILTERS : 2 * FILTERS] = np.maximum(pooled[:, FILTERS : 2 * FILTERS], last)
            out[at : at + 64] = _softmax(np.maximum(pooled, 0) @ self.dense + self.bias)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, the text each belongs to, and its real bytes.  An empty text has one empty window."""
    sizes = np.array([len(t) for t in texts])
    n = np.maximum(1, -(-sizes // WINDOW))
    padded = b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n.tolist(), strict=True))
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, WINDOW), owner, np.minimum(WINDOW, sizes[owner] - place * WINDOW)


def train(samples: dict[str, list[str]], seed: int = 7) -> ByteCnn | None:
    """Fits the network on windows of text by label; half of the windows are shortened, so that short texts are learned too."""
    labels = sorted(samples)
    texts = [(w.encode(), k) for k, lang in enumerate(labels) for w in samples[lang] if w]
    if not texts:
        return None
    cut = [t[: 16 + zlib.crc32(t) % (WINDOW - 16) if zlib.crc32(t) & 1 else WINDOW] for t, _ in texts]
    return ByteCnn(labels, seed).fit(cut_windows(cut)[0].astype(np.intp), np.array([k for _, k in texts]))


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """docs with lang_pred and score."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    flag = "_letters"  # beside the text, which is sent to the workers only once
    while flag in kept:
        flag += "_"
    weights = docs.sparkSession.sparkContext.broadcast(model)  # some 60 KB, set by the network's shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # a worker that has encoded before would hold what it remembers beside the windows
        net = weights.value
        tables = net.tables() if net else None
        for batch in by_bytes(batches, "text"):
            texts = [t.encode() if letters else b"" for t, letters in zip(batch.column("text").to_pylist(), batch.column(flag).to_pylist(), strict=True)]
            labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if net:
                windows, owner, real = cut_windows(texts)
                p = net.probabilities(windows, tables).astype(np.float64) * real[:, None]
                sums = np.zeros((len(texts), p.shape[1]))
                np.add.at(sums, owner, p)
                for k, t in enumerate(texts):
                    if t:
                        best = int(sums[k].argmax())
                        labels[k], scores[k] = net.labels[best], min(1.0, float(sums[k, best] / len(t)))
            columns = [*(batch.column(c) for c in kept), pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    return docs.select(*kept, F.col("text").rlike(r"\p{L}").alias(flag)).mapInArrow(run, schema)


def identify(docs: DataFrame, max_docs_per_label: int = 1000) -> DataFrame:
    """docs with lang_pred and score, by a network fitted on the labelled rows of docs that aren't held out."""
    return predict(docs, train(training_windows(docs.select("doc_id", "text", "lang"), max_docs_per_label)))
