"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, pieces, record_batch, releasing

BUCKETS = 1 << 14
SIZES = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
#: Numbers of a product of counts and the matrix that are in memory at a time.
CELLS = 1 << 21
MULTIPLIERS = (2654435761, 2246822519, 3266489917)


def buckets(text: str, n_buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every character n-gram, in the lower-cased text with a space at each end."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - (n_buckets.bit_length() - 1))
    out = []
    for n in SIZES:
        if len(points) < n:
            break
        mixed = points[: len(points) - n + 1] * np.uint32(MULTIPLIERS[0]) + np.uint32(n)
        for k in range(1, n):
            mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(MULTIPLIERS[k]) + points[k : len(points) - n + 1 + k]
        out.append((mixed ^ mixed >> np.uint32(15)) * np.uint32(MULTIPLIERS[0]) >> shift)
    return np.concatenate(out)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(docs: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n, docs): n-gram counts over all rows of (lang, text), summed in each task before the shuffle; the
    documents of a language stand under bucket -1."""

    def run(batches):
        found: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for part, texts in pieces(batch):
                for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    if lang not in found:
                        found[lang], seen[lang] = np.zeros(n_buckets, np.int64), 0
                    found[lang] += np.bincount(buckets(text.decode(errors="replace"), n_buckets), minlength=n_buckets)
                    seen[lang] += 1
        for lang, n in found.items():
            used = np.flatnonzero(n)
            yield record_batch(lang=[lang] * (len(used) + 1), bucket=np.append(used, -1).astype(np.int32), n=np.append(n[used], seen[lang]))

    return docs.select("lang", "text").mapInArrow(releasing(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """langs in order, prior log-probabilities, and the matrix of log-probabilities (buckets x languages)."""

    def __init__(self, langs: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.langs, self.prior, self.matrix = langs, prior, matrix

    @classmethod
    def fit(cls, rows: list[tuple[str, int | np.ndarray, int | np.ndarray]], n_buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> Model:
        langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(langs)}
        n, docs = np.full((n_buckets, len(langs)), smoothing), np.zeros(len(langs))
        for lang, bucket, count in rows:
            bucket, count = np.atleast_1d(bucket), np.atleast_1d(count)
            docs[at[lang]] += count[bucket < 0].sum()
            n[bucket[bucket >= 0], at[lang]] += count[bucket >= 0]
        return cls(langs, np.log(np.maximum(docs, 1) / max(docs.sum(), 1)), np.log(n / n.sum(axis=0)))

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities (texts x languages): the texts' bucket counts as sparse rows, multiplied with blocks of the matrix's columns."""
        if not texts:
            return np.zeros((0, len(self.langs)))
        counts = [np.bincount(buckets(t, len(self.matrix)), minlength=len(self.matrix)) for t in texts]
        column = [np.flatnonzero(n) for n in counts]
        begins = np.cumsum([0, *map(len, column[:-1])])
        value = np.concatenate([n[c] for n, c in zip(counts, column, strict=True)])
        at, logs = np.concatenate(column), np.empty((len(texts), len(self.langs)))
        step = max(1, CELLS // len(at))
        for a in range(0, len(self.langs), step):  # a few languages at a time: a product has one number for each n-gram and language
            logs[:, a : a + step] = np.add.reduceat(value[:, None] * self.matrix[at, a : a + step], begins, axis=0)
        logs += self.prior
        logs = np.exp(logs - logs.max(axis=1, keepdims=True))
        return logs / logs.sum(axis=1, keepdims=True)


#: Languages that a model may have: it comes to the driver, a number for each bucket and language.
MOST_LANGUAGES = 2000


def train(docs: DataFrame, n_buckets: int = BUCKETS) -> Model:
    """A model of (text, lang) rows with a language; null texts count as empty. What comes to the driver is one number
    for each bucket and language, whatever the number of documents; more than MOST_LANGUAGES raise a ValueError."""
    found = counts(docs.where("lang is not null"), n_buckets)
    if docs.where("lang is not null").select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    lists = found.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("all")).select("lang", "all.bucket", "all.n").toArrow()
    numbers = lambda c, i: lists.column(c)[i].values.to_numpy(zero_copy_only=False)
    return Model.fit([(lang, numbers("bucket", i), numbers("n", i)) for i, lang in enumerate(lists.column("lang").to_pylist())], n_buckets)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; `und` with score 0 for a text that is null or has no letter,
    and for every text if no language was learned."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.matrix))

    def make():
        own = Model(*sent.value)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, texts in pieces(batch, limit=1 << 18):
                decoded = [t.decode(errors="replace") for t in texts]
                known = [i for i, t in enumerate(decoded) if own.langs and has_letter(t)]
                lang, score = [UNKNOWN] * len(decoded), np.zeros(len(decoded))
                if known:
                    found = own.score([decoded[i] for i in known])
                    score[known] = found.max(axis=1)
                    for i, k in zip(known, found.argmax(axis=1), strict=True):
                        lang[i] = own.langs[k]
                yield record_batch(doc_id=part.column(0), held_out=part.column(1), lang_pred=lang, score=score)

        return each

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return map_batches(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then predict for all. Needs doc_id, text and lang; other columns
    are not read. Repeated rows count and are returned as often as they stand; an empty table gives no rows. A very long text is
    worked on as a whole, alone in its task: about 40 bytes of memory for each of its own."""
    return predict(docs, train(docs.where(~held_out()).select("lang", "text")))
