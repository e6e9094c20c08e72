"""Quality classifier: hashed vectors of words and character n-grams, averaged per document, under a softmax; trained by numpy SGD.

A trained model is linear in the average of its vectors, so for scoring each bucket's vector is folded into one number
per bucket: its part of the difference of the two logits. Scoring then reads one number per word or n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _textnp as tn
from ._shared import quoted, small_batches, training_rows

#: Buckets that words and n-grams are hashed into, size of their vectors, and bytes of an n-gram.
BUCKETS_LOG2, DIM, GRAMS = 17, 16, (3, 4)
#: Labelled documents, and bytes of their texts, that a model is trained on at most (about; they are chosen by a hash of the id).
MAX_TRAIN, MAX_BYTES = 4000, 16_000_000


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dim
    output: np.ndarray  # 2 x dim
    bias: np.ndarray  # 2

    def folded(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the difference of logits, and the constant."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word, word pair and n-gram inside a word, its two edges included; case counts.

    A pair hashes to the difference of its words' hashes, so that all words said twice share one bucket.
    """
    shift = np.uint64(64 - BUCKETS_LOG2)
    w = tn.words(data, offsets, lower=False)
    hashes = w.hashes()
    pairs = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    buckets = [(hashes >> shift).astype(np.int32), (tn.mixed(hashes[pairs + 1] - hashes[pairs] + tn.BASE) >> shift).astype(np.int32)]
    docs = [w.doc, w.doc[pairs]]
    # A blank before each text and after the last: edges of words at the ends of texts.
    sizes = np.diff(offsets)
    padded = np.full(len(data) + len(sizes) + 1, 32, np.uint8)
    text = np.repeat(np.arange(len(sizes)), sizes)
    padded[np.arange(len(data)) + text + 1] = data
    solid = ~tn.SPACE[padded]
    padded[~solid] = 32
    of = np.zeros(len(padded), np.int64)
    of[np.arange(len(data)) + text + 1] = text
    for n in GRAMS:
        if len(padded) < n:
            continue
        m = len(padded) - n + 1
        value, inside = np.full(m, n, np.uint64), np.ones(m, bool)
        for j in range(n):
            value = (value << np.uint64(8)) | padded[j : j + m]
            if 0 < j < n - 1:
                inside &= solid[j : j + m]
        at = np.flatnonzero(inside)
        buckets.append(((value[at] * tn.BASE) >> shift).astype(np.int32))
        docs.append(of[at + 1])
    return np.concatenate(buckets), np.concatenate(docs)


def train(texts: list[str | None] | pa.Array, labels: np.ndarray, *, epochs: int = 5, rate: float = 0.5, seed: int = 0) -> Model:
    """SGD over single documents with a falling step; no texts: a model that scores all the same."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKETS_LOG2, DIM)).astype(np.float32), np.zeros((2, DIM), np.float32), np.zeros(2, np.float32))
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, data, offsets in tn.chunks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
        bucket, doc = features(data, offsets)
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(offsets)))
        for a, b in zip(cuts, cuts[1:]):
            ids, times = np.unique(bucket[order[a:b]], return_counts=True)
            bags.append((ids, (times / max(1, b - a)).astype(np.float32)))
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    model.bias[:] = [np.log(1 - share), np.log(share)]
    steps = max(1, epochs * len(bags))
    for step, k in enumerate(i for _ in range(epochs) for i in rng.permutation(len(bags))):
        ids, part = bags[k]
        held = model.vectors[ids]
        hidden = part @ held
        logits = model.output @ hidden + model.bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[int(labels[k])] -= 1
        now = rate * (1 - step / steps)
        back = p @ model.output
        model.output -= now * np.outer(p, hidden)
        model.bias -= 0.02 * now * p
        model.vectors[ids] = held - (now * part[:, None] * len(part) ** 0.5) * back
    del bags
    tn.trim()
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, label: str = "quality", most: int = MAX_TRAIN) -> Model:
    """A model of ``labels`` (doc_id and ``label``, 0 or 1) on at most about ``most`` documents, and MAX_BYTES of text, for which ``usable`` (of doc_id) holds.

    Null ids and labels teach nothing; neither do labels without a document. Repeated rows count as often as they stand there. Rows are
    taken in order of id, label and text, so that reruns train the same model.
    """
    return train(*training_rows(docs, labels, usable, label, 31, most, MAX_BYTES))


def score(df: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` (its text left out) with the probability of label 1 as ``name``; empty and null texts get the score of no features."""
    small_batches(df.sparkSession)
    parts, constant = model.folded()
    shared = df.sparkSession.sparkContext.broadcast(parts)
    others = [c for c in df.columns if c.lower() not in (text.lower(), name.lower())]
    schema = df.select(*[F.col(quoted(c)) for c in others], F.lit(0.0).alias(name)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for a, b, data, offsets in tn.chunks(batch.column(len(others))):
                bucket, doc = features(data, offsets)
                total = np.bincount(doc, held[bucket], minlength=b - a)
                out[a:b] = total / np.maximum(1, np.bincount(doc, minlength=b - a)) + constant
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), pa.array(tn.sigmoid(out))], [*others, name])
        tn.trim()

    return df.select(*[F.col(quoted(c)) for c in others], F.col(quoted(text)).cast("string").alias("_text")).mapInArrow(scored, schema)
