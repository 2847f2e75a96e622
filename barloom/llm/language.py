"""Language identification word first: known words by their log frequency in each language, unseen ones by character n-grams."""
from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

#: Labelled documents from which a model is learnt, all languages together, and the bytes of their texts.
TRAIN_DOCS, TRAIN_BYTES = 4000, 24 << 20
#: Lengths of character n-grams, longest first.
ORDERS = (4, 3, 2, 1)
#: Unseen words whose scores a task remembers.
REMEMBERED = 200_000
#: Words whose n-grams are held at once.
CHUNK = 16_384
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS.findall(text.lower())


class Backoff:
    """Log frequencies of words and n-grams by language; ``counts`` maps (language, word) to its number, or is a table ``lang, word, n``."""

    def __init__(self, counts: dict[tuple[str, str], int] | pa.Table, smoothing: float = 0.5):
        if not isinstance(counts, pa.Table):
            counts = pa.table({"lang": pa.array([k[0] for k in counts], pa.string()), "word": pa.array([k[1] for k in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        langs, words = (counts[c].combine_chunks().dictionary_encode() for c in ("lang", "word"))
        known = langs.dictionary.to_pylist()
        self.languages = sorted(known)
        place = np.array([self.languages.index(lang) for lang in known], np.int64)
        names, n = words.dictionary.to_pylist(), np.zeros((len(words.dictionary), len(known)))
        np.add.at(n, (words.indices.to_numpy(), place[langs.indices.to_numpy()]), counts["n"].to_numpy())
        self.words, self.word_scores = self.logs({w: i for i, w in enumerate(names)}, n, smoothing)
        self.tables = [self.logs(*self.summed(names, n, order), smoothing) for order in ORDERS]
        self.prior = int(np.argmax(n.sum(axis=0))) if names else 0

    @classmethod
    def summed(cls, words: list[str], n: np.ndarray, order: int) -> tuple[dict[str, int], np.ndarray]:
        """Numbers of the words' n-grams and their counts by language, without an object for each count."""
        index, totals = {}, np.zeros((0, n.shape[1]))
        for start in range(0, len(words), CHUNK):
            found, of = array("q"), array("q")
            for i in range(start, min(start + CHUNK, len(words))):
                for g in cls.grams(words[i], order):
                    found.append(index.setdefault(g, len(index)))
                    of.append(i)
            if found:
                found, of, before = np.frombuffer(found, np.int64), np.frombuffer(of, np.int64), totals
                totals = np.column_stack([np.bincount(found, column[of], len(index)) for column in n.T])
                totals[:len(before)] += before
        return index, totals

    @staticmethod
    def grams(word: str, order: int) -> list[str]:
        """N-grams of a word with its ends marked; single characters without marks."""
        marked = f"<{word}>" if order > 1 else word
        return [marked[i:i + order] for i in range(len(marked) - order + 1)]

    @staticmethod
    def logs(index: dict[str, int], n: np.ndarray, smoothing: float) -> tuple[dict[str, int], np.ndarray]:
        if not index:
            return {}, np.zeros((0, 0), np.float32)
        return index, np.log((n + smoothing) / (n + smoothing).sum(axis=0)).astype(np.float32)

    def unseen(self, word: str) -> np.ndarray | None:
        """Mean log frequency of the word's known n-grams of the longest order that has any."""
        for (index, scores), order in zip(self.tables, ORDERS):
            known = [index[g] for g in self.grams(word, order) if g in index]
            if known:
                return scores[known].mean(axis=0)
        return None

    def predict(self, text: str | None, seen: dict[str, np.ndarray | None]) -> tuple[str, float]:
        """Language and score; the score is the softmax of the mean word score times the root of the number of words."""
        words = words_of(text) if text else []
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        total, n, rows, get = np.zeros(len(self.languages)), 0, [], self.words.get
        for w in words:
            i = get(w)
            if i is not None:
                rows.append(i)
                continue
            if w not in seen:
                seen[w] = self.unseen(w)
            if seen[w] is not None:
                total += seen[w]
                n += 1
        if rows:
            total += self.word_scores[rows].sum(axis=0)
        n += len(rows)
        if not n:
            return self.languages[self.prior], 1 / len(self.languages)
        logit = total / n * np.sqrt(n)
        best = int(np.argmax(logit))
        return self.languages[best], float(1 / np.exp(logit - logit[best]).sum())


def learn(labelled: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Backoff:
    """A model from rows of ``text`` and ``lang``, of which about ``train_docs`` (shared evenly by the languages) are used.

    The sample is taken by a hash of the text, within ``train_bytes`` for all; smaller tables are used whole. Words are counted by Spark.
    """
    labelled = labelled.filter("text is not null and lang is not null").select("text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()
    share = max(1, len(sizes))
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_docs / share / r["n"], train_bytes / share / max(1, r["b"])))]) if sizes else None
    if rate is None:
        return Backoff({})
    sample = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(rate, F.col("lang")) * (1 << 20))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((lang, w) for w in words_of(text))
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=schema.names)

    totals = sample.mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Backoff(totals.toArrow())


def in_learning(doc_id) -> F.Column:
    """True for rows whose crc32 of the id as text leaves a remainder other than 0 by 5; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def identify(docs: DataFrame, model: Backoff, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), map-only.

    Null texts and texts without a letter, and all texts where nothing was learnt, are ``und`` with score 0. Texts of which no
    character was seen before get the language of most words and an even score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        model, seen = sent.value, {}
        for texts in batches:
            out = []
            for t in texts:
                out.append(model.predict(None if t is None else t.decode(), seen))
                if len(seen) > REMEMBERED:
                    seen.clear()
            yield [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]

    return annotate(docs, text, fields, run)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is determined with at least this score; the model is learnt from their own labels."""
    model = learn(docs.filter(in_learning(F.col("doc_id"))))
    found = identify(docs, model)
    lang, score = found.columns[-2:]
    return found.filter((F.col(f"`{lang}`") != UNDETERMINED) & (F.col(f"`{score}`") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
