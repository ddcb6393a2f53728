"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded; gated attention weighs the passages; the weighted
sum is scored. Only documents have labels, so the weights are learned from these. The network is small and is trained in
numpy on the driver, on a bounded sample of labelled documents; scoring runs in the executors over every passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_batches, pieces

PASSAGE_WORDS = 64
PAIR_BUCKETS = 64
#: Bytes by class: the share of each in a passage is a feature. The last class takes what no other has.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", b"#*$%&<>", b"|", b".,;:", b"!?", b"'\"()[]{}", bytes(range(128, 256)))
N_CLASSES = len(CLASSES) + 1
FEATURES = N_CLASSES + PAIR_BUCKETS + 5
#: Labelled documents that the model is fitted on, half of each label if there are as many; lowest hashes of the id.
SAMPLE_DOCS = 3000
#: Passages that are encoded at a time; a text of more is encoded in such chunks, each by itself.
CHUNK_PASSAGES = 2048
HIDDEN, GATE = 24, 12
THRESHOLD = 0.7

CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _i, _bytes in enumerate(CLASSES):
    CLASS_OF[list(_bytes)] = _i
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256)
FOLD[65:91] += 32


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES, passages of each text). A text without words is one passage without features."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.repeat(np.arange(len(texts)), size)
    white = WHITE[data]
    begins = ~white & np.append(True, white[:-1])
    word = np.cumsum(begins)
    first = np.cumsum(size) - size
    before = word[first] - begins[first]
    number = np.maximum(word - before[doc] - 1, 0)
    words = np.bincount(doc[begins], minlength=len(texts))
    passages = np.maximum((words + PASSAGE_WORDS - 1) // PASSAGE_WORDS, 1)
    start = np.cumsum(passages) - passages
    passage = start[doc] + number // PASSAGE_WORDS
    n = int(passages.sum())
    length = np.maximum(np.bincount(passage, minlength=n), 1)[:, None]
    shares = np.bincount(passage * N_CLASSES + CLASS_OF[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / length
    folded = FOLD[data]
    pair = (folded[:-1] * 31 + folded[1:] * 17) * 2654435761 % (1 << 32) >> 26
    inside = doc[:-1] == doc[1:]  # a text's features must not depend on its neighbours
    pairs = np.bincount((passage[:-1] * PAIR_BUCKETS + pair)[inside], minlength=n * PAIR_BUCKETS).reshape(n, PAIR_BUCKETS) / length
    own_words = np.bincount(passage[begins], minlength=n)
    letters = np.bincount(passage, weights=~white, minlength=n) / np.maximum(own_words, 1)
    lines = np.bincount(passage, weights=data == 10, minlength=n) / np.maximum(own_words, 1)
    # A word counts as like an earlier one if both have its bytes' sum, number and last byte.
    at = np.flatnonzero(begins)
    ends = np.flatnonzero(~white & np.append(white[1:], True))
    total = np.cumsum(data, dtype=np.int64)
    like = (total[ends] - total[at] + data[at]) << 24 | (ends - at) << 8 | data[ends]
    again = [np.bincount(passage[at[k:]], weights=(like[k:] == like[: len(like) - k]) & (doc[at[k:]] == doc[at[: len(at) - k]]), minlength=n) / np.maximum(own_words, 1) for k in (1, 2)]
    return np.column_stack([shares, pairs, np.log1p(letters), np.log1p(own_words), lines, *again]).astype(np.float32), passages


def chunks(text: bytes, passages: int = CHUNK_PASSAGES) -> list[bytes]:
    """The text cut before every so many passages' first word. Finding the cuts takes about 10 bytes of memory for each of a long
    text's own, encoding a chunk 72 for each of the chunk's."""
    if len(text) < 2 * PASSAGE_WORDS * passages:  # too short for as many words
        return [text]
    white = WHITE[np.frombuffer(text, np.uint8)]
    begins = np.flatnonzero(~white & np.append(True, white[:-1]))[PASSAGE_WORDS * passages :: PASSAGE_WORDS * passages].tolist()
    return [text[a:b] for a, b in zip([0, *begins], [*begins, len(text)], strict=True)]


def bag(text: bytes) -> np.ndarray:
    """The passages' features of one text."""
    return np.concatenate([encode([c])[0] for c in chunks(text)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """mean, scale: of features; w1, b1: the passage encoder; v, u, a: the gated attention; c, d: the scorer."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.weights, np.cumsum(counts) - counts
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        weight = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(weight[:, None] * h, at, axis=0)
        return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Texts of one chunk are scored together; a longer one by running sums over its chunks, weighed by the largest
        attention so far."""
        if not self.weights:
            return np.full(len(texts), 0.5)
        parts = [chunks(t) for t in texts]
        out = np.zeros(len(texts))
        short = [i for i, p in enumerate(parts) if len(p) == 1]
        if short:
            x, counts = encode([texts[i] for i in short])
            out[short] = self._forward((x - self.mean) / self.scale, counts)["score"]
        for i in set(range(len(texts))) - set(short):
            out[i] = self._running(parts[i])
        return out

    def _running(self, parts: list[bytes]) -> float:
        p, top, total, z = self.weights, -np.inf, 0.0, 0.0
        for part in parts:
            x = (encode([part])[0] - self.mean) / self.scale
            h = np.tanh(x @ p["w1"] + p["b1"])
            e = (np.tanh(h @ p["v"]) * _sigmoid(h @ p["u"])) @ p["a"]
            last, top = top, max(top, float(e.max()))
            keep, weight = np.exp(last - top), np.exp(e - top)
            total, z = total * keep + weight.sum(), z * keep + weight @ h
        return float(_sigmoid(z / total @ p["c"] + p["d"]))

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
        """Adam on the log loss of documents, both labels weighing the same. Without both labels, a model that scores the
        share of label 1 (0.5 without any) for every text."""
        if len(set(labels.tolist())) < 2:
            return cls(np.zeros(FEATURES), np.ones(FEATURES), {}) if not len(labels) else cls.constant(float(labels[0]))
        rng = np.random.default_rng(seed)
        every = np.concatenate(bags)
        mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        bags = [(b - mean) / scale for b in bags]
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        model = cls(mean, scale, {"w1": init(FEATURES, HIDDEN), "b1": np.zeros(HIDDEN), "v": init(HIDDEN, GATE), "u": init(HIDDEN, GATE), "a": init(GATE), "c": init(HIDDEN), "d": np.zeros(())})
        p = model.weights
        first, second = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        share = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for s in range(0, len(order), batch):
                rows = order[s : s + batch]
                x, counts = np.concatenate([bags[i] for i in rows]), np.array([len(bags[i]) for i in rows])
                f = model._forward(x, counts)
                error = (f["score"] - labels[rows]) * share[rows] / len(rows)
                dz = np.repeat(error[:, None] * p["c"], counts, axis=0)
                along = (dz * f["h"]).sum(axis=1)
                de = f["weight"] * (along - np.repeat(np.add.reduceat(f["weight"] * along, np.cumsum(counts) - counts), counts))
                dt, dg = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
                dh = (f["weight"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
                grads = {"w1": x.T @ dh, "b1": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ error, "d": error.sum()}
                step += 1
                for k, grad in grads.items():
                    grad = grad + decay * p[k]
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad**2
                    p[k] = p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return model

    @classmethod
    def constant(cls, score: float) -> Model:
        zero = {"w1": np.zeros((FEATURES, 1)), "b1": np.zeros(1), "v": np.zeros((1, 1)), "u": np.zeros((1, 1)), "a": np.zeros(1), "c": np.zeros(1), "d": np.array(np.log((score + 0.01) / (1.01 - score)))}
        return cls(np.zeros(FEATURES), np.ones(FEATURES), zero)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled documents that are not held out. Labels that are not 0 or 1, or that differ for one doc_id, are left
    out; of documents with one doc_id, one is taken. What comes to the driver are the features of sample_docs documents."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("most")).where("label = most")
    total = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    half = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs // 2) for k in (0, 1)]
    chosen = half[0].union(half[1]).select("doc_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "label", "text")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, found in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([bag(t).tobytes() for t in found], pa.binary())], names=["doc_id", "label", "bag"])

        return each

    found = sorted(map_batches(rows, make, "doc_id long, label int, bag binary").collect())
    model = Model.fit([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in found], np.array([r.label for r in found], np.int64))
    if model.weights and len(total) == 2:  # both labels weighed the same in the fit; now they stand as in all labels
        model.weights["d"] = model.weights["d"] + np.log(total[1] / total[0])
    return model


def with_scores(rows: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """The rows with one more column: a score from 0 to 1 of each whole text, higher if label 1 is likelier. Null and empty
    texts are scored as a passage without words."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, texts in pieces(batch, text, limit=1 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.score(texts))], names=[*part.schema.names, name])

        return each

    return map_batches(rows, make, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row. Repeated rows are all returned; empty tables give no rows; columns
    but doc_id and text (and quality of the labels) are not read. A very long text is encoded in chunks of 2048 passages, so it
    takes about 10 bytes of memory for each of its own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").alias("text"))
    rows = with_scores(rows, train(docs, labels))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
