"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly."""
from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

#: Labelled documents of each class from which a model is learnt, and the bytes of their texts.
TRAIN_DOCS, TRAIN_BYTES = 1500, 8 << 20
#: Hash buckets of subwords (a power of two), and dimensions of their vectors.
BUCKETS, DIMENSIONS = 1 << 17, 4
#: A subword gets a vector if it occurs in so many documents of the sample, and if the classes' shares of documents with it differ by so
#: many standard deviations; all others would only be learnt by heart.
LEAST_DOCS, TELLING = 3, 3.0
#: Steps of learning, their size, the decay of vectors, and the factor on mean vectors.
ROUNDS, RATE, DECAY, SCALE = 100, 0.05, 3e-5, 50.0
#: Words without a vector that are added to every text, and the largest share of one word, so that neither a word of a short text nor
#: one repeated without end decides alone.
BLANKS, MOST = 20, 0.005
#: Words whose scores a task remembers.
REMEMBERED = 400_000
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def subwords(word: str) -> list[int]:
    """Buckets of a word itself and of its character 3-, 4- and 5-grams, ends marked; a long run is cut at 64 characters a piece."""
    out = []
    for a in range(0, len(word), 64):
        marked = f"<{word[a:a + 64]}>"
        out.append(zlib.crc32(marked.encode()) & BUCKETS - 1)
        for n in (3, 4, 5):
            out += [zlib.crc32(marked[i:i + n].encode()) & BUCKETS - 1 for i in range(len(marked) - n + 1)]
    return out


@dataclass
class Model:
    """A score for every bucket (its vector times the difference of the two classes' weights), and a bias."""

    buckets: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.buckets[subwords(word)].mean())

    def score(self, text: str | None, seen: dict[str, float]) -> float:
        words = words_of(text) if text else []
        counts, total = Counter(words), 0.0
        all_words = len(words) + BLANKS
        for w, n in counts.items():
            s = seen.get(w)
            if s is None:
                s = seen[w] = self.word(w)
            total += s * min(n / all_words, MOST)
        logit = self.bias + total
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


class Sums:
    """Sums of rows by owner, with a weight for each entry: ``rows[at] * weight`` summed over the entries of an owner, and back."""

    def __init__(self, owner: np.ndarray, at: np.ndarray, weight: np.ndarray, owners: int, n: int):
        self.sizes = owners, n
        by_row = np.argsort(at, kind="stable")
        self.forth = self.sorted(owner, at, weight)
        self.back = self.sorted(at[by_row], owner[by_row], weight[by_row])

    @staticmethod
    def sorted(owner, at, weight):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        return owner[starts], starts, at, weight[:, None].astype(np.float32)

    def _sum(self, rows, plan, n):
        owners, starts, at, weight = plan
        out = np.zeros((n, rows.shape[1]), np.float32)
        out[owners] = np.add.reduceat(rows[at] * weight, starts, axis=0)
        return out

    def __call__(self, rows):
        return self._sum(rows, self.forth, self.sizes[0])

    def transposed(self, rows):
        return self._sum(rows, self.back, self.sizes[1])


def telling(seen_in: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether the shares of the two classes' documents with a subword differ by more than ``TELLING`` standard deviations."""
    pooled = seen_in.sum(axis=0) / docs.sum()
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / docs[0] + 1 / docs[1]))
    return np.abs(seen_in[1] / docs[1] - seen_in[0] / docs[0]) > TELLING * spread


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY, seed: int = 7, least_docs: int = LEAST_DOCS) -> Model:
    """Vectors of subwords and softmax weights, learnt together by gradient descent on whole batches, classes weighing the same.

    A word's vector is the mean of its subwords' vectors, a text's the mean of its words' (shares limited, see ``MOST``). Steps are
    Adam's. Without two classes, or subwords that tell them apart, the model is a constant.
    """
    bags = [Counter(words_of(t)) for t in texts]
    kept = [i for i, b in enumerate(bags) if b]
    y = np.asarray([labels[i] for i in kept], np.int64)
    if len(set(y.tolist())) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    vocabulary: dict[str, int] = {}
    doc_words, doc_share, docs = [], [], []
    for k, i in enumerate(kept):
        n = sum(bags[i].values())
        for w, c in bags[i].items():
            doc_words.append(vocabulary.setdefault(w, len(vocabulary)))
            doc_share.append(min(c / (n + BLANKS), MOST))
            docs.append(k)
    parts = [np.asarray(subwords(w)) for w in vocabulary]
    lengths = np.asarray([len(p) for p in parts])
    seen_in = np.zeros((2, BUCKETS))
    doc_words, docs = np.asarray(doc_words), np.asarray(docs)
    ends = np.searchsorted(docs, np.arange(len(kept) + 1))
    for label, a, b in zip(y, ends[:-1], ends[1:]):
        seen_in[label, np.unique(np.concatenate([parts[w] for w in doc_words[a:b]]))] += 1
    word, bucket = np.repeat(np.arange(len(parts)), lengths), np.concatenate(parts)
    common = telling(seen_in, np.bincount(y, minlength=2))[bucket] & (seen_in.sum(axis=0) >= least_docs)[bucket]
    used, at = np.unique(bucket[common], return_inverse=True)
    if not len(used):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    word = word[common]
    to_words = Sums(word, at, 1 / lengths[word], len(parts), len(used))
    to_docs = Sums(docs, doc_words, np.asarray(doc_share) * SCALE, len(kept), len(parts))
    random = np.random.default_rng(seed)
    state = [random.normal(0, 0.01, (len(used), DIMENSIONS)).astype(np.float32), random.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)]
    speed, size = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())[:, None]
    truth = np.eye(2)[y]
    for step in range(1, rounds + 1):
        vectors, weights, bias = state
        hidden = to_docs(to_words(vectors))
        logit = hidden @ weights + bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        error = ((p / p.sum(axis=1, keepdims=True) - truth) * share).astype(np.float32)
        gradients = [to_words.transposed(to_docs.transposed(error @ weights.T)) + decay * vectors, hidden.T @ error, error.sum(axis=0)]
        for k, g in enumerate(gradients):
            speed[k] = 0.9 * speed[k] + 0.1 * g
            size[k] = 0.99 * size[k] + 0.01 * g * g
            state[k] = state[k] - rate * speed[k] / (1 - 0.9**step) / (np.sqrt(size[k] / (1 - 0.99**step)) + 1e-9)
    vectors, weights, bias = state
    buckets = np.zeros(BUCKETS, np.float32)
    buckets[used] = vectors @ (weights[:, 1] - weights[:, 0]) * SCALE
    return Model(buckets, float(bias[1] - bias[0]))


def remainder(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """A model from labelled documents whose id's crc32 leaves a remainder other than 1 by 3.

    About ``train_docs`` labels of each class are drawn by a hash of the id; only their few ids are joined to ``docs``. If their
    texts exceed ``train_bytes`` for both classes, fewer are taken. Labels other than 0 and 1, and null ids and texts, are left out.
    """
    usable = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(remainder(F.col("doc_id")) != 1)
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return train([], [])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) / (1 << 24)
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, train_docs / n))])
    drawn = usable.withColumn("place", place).filter(F.col("place") < F.element_at(rate, F.col("toxic")))
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(drawn), "doc_id")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > 2 * train_bytes:
        texts = texts.filter(F.col("place") < F.element_at(rate, F.col("toxic")) * (2 * train_bytes / size))
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in texts.select("doc_id", "toxic", "text").collect())
    return train([r[2] for r in rows], [r[1] for r in rows])


def rate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), map-only. Null texts and texts without words get the model's bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, seen = sent.value, {}
        for texts in batches:
            scores = []
            for t in texts:
                scores.append(model.score(None if t is None else t.decode(), seen))
                if len(seen) > REMEMBERED:
                    seen.clear()
            yield [pa.array(scores, pa.float64())]

    return annotate(docs, text, T.StructType([T.StructField("score", T.DoubleType())]), run)
