"""Toxic spans by a linear-chain conditional random field of two states over words.

Features of a word are hashes of the word, of its first letters and of its last ones. Token labels come from labelled
documents: a word is labelled toxic where it, or how it begins, stands in toxic documents far more often than
chance. The field is trained by stochastic gradients of its likelihood; forward-backward marginals give spans, and a
logistic law over a document's marginals its score. With two states each pass is one recurrence of log-odds, run
over many documents side by side.
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

BUCKETS_LOG2 = 18
#: Bytes at the beginning and at the end of a word that make features.
HEADS, TAILS = (4, 5, 6, 7, 8), (4,)
#: Labelled documents, and bytes of their texts, that a model is trained on at most (about; they are chosen by a hash of the id).
MAX_TRAIN, MAX_BYTES = 4000, 16_000_000
#: A feature marks toxic words if so many toxic documents have it and its smoothed odds are so many times even,
LEAST_DOCS, LEAST_ODDS = 4, 12.0
#: And if chance would hardly do that: twice the log-likelihood ratio of its documents.
LEAST_RATIO = 30.0
#: Bytes of punctuation taken off each edge of a word.
EDGE = 4
#: Words that a group of documents run side by side fills at most, blanks included.
CELLS = 1 << 19
#: Bytes of text whose documents are run side by side.
SIDE_BY_SIDE = 1 << 20
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


@dataclass
class Model:
    weights: np.ndarray  # of each feature, for state 1 against state 0
    moves: np.ndarray  # 2 x 2, from and to
    start: float
    law: np.ndarray  # of the parts of ``summary``


@dataclass
class Tokens:
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    features: np.ndarray  # words x features


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Words without the punctuation (ASCII, up to EDGE bytes) at their edges, and their features; A-Z as a-z."""
    w = tn.words(data, offsets)
    start, stop = w.start.copy(), w.stop.copy()
    for _ in range(EDGE):
        stop -= PUNCTUATION[data[stop - 1]] & (stop - 1 > start)
        start += PUNCTUATION[data[start]] & (start + 1 < stop)
    shift = np.uint64(64 - BUCKETS_LOG2)
    found = [w.spans(start, stop)]
    for k, m in enumerate(HEADS):
        found.append(tn.mixed(w.spans(start, np.minimum(stop, start + m)) + np.uint64(k + 1)))
    for k, m in enumerate(TAILS):
        found.append(tn.mixed(w.spans(np.maximum(start, stop - m), stop) + np.uint64(100 + k)))
    return Tokens(start, stop, w.first, np.stack([(x >> shift).astype(np.int32) for x in found], 1) if len(start) else np.zeros((0, 1 + len(HEADS) + len(TAILS)), np.int32))


def groups(first: np.ndarray, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Documents of like length, so many at a time that their words fill at most ``cells`` places; longest first."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        take = max(1, cells // int(sizes[order[at]]))
        yield order[at : at + take]
        at += take


def forward_backward(scores: np.ndarray, live: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of state 1 from the left (own score included) and from the right (own score left out); time x documents.

    ``live[t]``: how many documents, longest first, have a word t.
    """
    t00, t01, t10, t11 = np.exp(moves).ravel()
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0] + start
    for t in range(1, len(scores)):
        n = live[t]
        odds = np.exp(np.clip(ahead[t - 1, :n], -50, 50))
        ahead[t, :n] = scores[t, :n] + np.log((t01 + t11 * odds) / (t00 + t10 * odds))
    for t in range(len(scores) - 2, -1, -1):
        n = live[t + 1]
        odds = np.exp(np.clip(back[t + 1, :n] + scores[t + 1, :n], -50, 50))
        back[t, :n] = np.log((t10 + t11 * odds) / (t00 + t01 * odds))
    return ahead, back


def laid_out(first: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word at each time of each document, or -1; live documents by time)."""
    sizes = (first[group + 1] - first[group]).astype(np.int64)
    time = np.arange(sizes[0])[:, None]
    return np.where(time < sizes[None, :], first[group][None, :] + time, -1), (time < sizes[None, :]).sum(1)


def marginals(tok: Tokens, model: Model) -> np.ndarray:
    """Log-odds that each word is toxic."""
    emitted = np.zeros(len(tok.features))
    for column in tok.features.T:
        emitted += model.weights[column]
    out = np.zeros(len(emitted))
    for group in groups(tok.first):
        place, live = laid_out(tok.first, group)
        ahead, back = forward_backward(np.where(place >= 0, emitted[place], 0.0), live, model.moves, model.start)
        here = place >= 0
        out[place[here]] = (ahead + back)[here]
    return out


def summary(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document: 1, the largest log-odds of a word, and logs of the expected number of toxic words and of their share."""
    n = len(first) - 1
    most = np.full(n, -20.0)
    has = np.diff(first) > 0
    if has.any():
        most[has] = np.maximum.reduceat(odds, first[:-1][has])
    expected = tn.per_text(tn.sigmoid(odds), first)
    return np.stack([np.ones(n), np.clip(most, -20, 20) / 5, np.log1p(expected), np.log((expected + 0.1) / (np.diff(first) + 20))], 1)


def token_labels(tok: Tokens, toxic: np.ndarray) -> np.ndarray:
    """1 for words of toxic documents that have a telling feature."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(tok.first))
    size = 1 << BUCKETS_LOG2
    counts = np.zeros((2, size))
    for column in tok.features.T:
        pairs = doc * np.int64(size)
        pairs += column
        pairs.sort()
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        of = toxic[pairs // size].astype(bool)
        counts[1] += np.bincount(pairs[of] % size, minlength=size)
        counts[0] += np.bincount(pairs[~of] % size, minlength=size)
    n = np.maximum(1, np.array([np.sum(toxic == 0), np.sum(toxic == 1)]))
    odds = ((counts[1] + 0.5) / (n[1] + 1)) / ((counts[0] + 0.5) / (n[0] + 1))
    expected = counts.sum(0) * (n / n.sum())[:, None]
    ratio = 2 * (counts * np.log(np.maximum(counts, 1e-9) / np.maximum(expected, 1e-9))).sum(0)
    telling = (counts[1] >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (ratio >= LEAST_RATIO)
    found = np.zeros(len(doc), bool)
    for column in tok.features.T:
        found |= telling[column]
    return found & toxic[doc].astype(bool)


def train(texts: list[str | None] | pa.Array, toxic: np.ndarray, *, epochs: int = 6, rate: float = 0.5, cells: int = 1 << 15) -> Model:
    """Adagrad on the likelihood of the token labels, then Newton steps for the document law. No texts: nothing counts as toxic."""
    model = Model(np.zeros(1 << BUCKETS_LOG2), np.zeros((2, 2)), 0.0, np.zeros(4))
    if not len(texts):
        model.law[0] = -4.0
        return model
    # Only features and lengths are kept, a chunk of texts at a time.
    features, sizes = [], []
    for _, _, data, offsets in tn.chunks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
        part = tokens(data, offsets)
        features.append(part.features)
        sizes.append(np.diff(part.first))
    none = np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    whole = np.empty((int(first[-1]), 1 + len(HEADS) + len(TAILS)), np.int32)
    at = 0
    while features:
        part = features.pop(0)
        whole[at : at + len(part)] = part
        at += len(part)
    tok = Tokens(none, none, first, whole)
    labels = token_labels(tok, toxic)
    squares, move_squares = np.full(len(model.weights), 1e-8), np.full((2, 2), 1e-8)
    model.weights[:] = 0.0
    model.start = -3.0
    rng = np.random.default_rng(0)
    batches = list(groups(tok.first, cells))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            place, live = laid_out(tok.first, batches[k])
            here = place >= 0
            scores = np.where(here, model.weights[tok.features[place]].sum(2), 0.0)
            ahead, back = forward_backward(scores, live, model.moves, model.start)
            p, y = tn.sigmoid(ahead + back), np.where(here, labels[place], False)
            slope = (p - y)[here]
            np.add.at(total := np.zeros(len(model.weights)), tok.features[place[here]].ravel(), np.repeat(slope, tok.features.shape[1]))
            touched = np.flatnonzero(total)
            squares[touched] += total[touched] ** 2
            model.weights[touched] -= rate * total[touched] / np.sqrt(squares[touched])
            # Expected and seen moves.
            both = here[1:] & here[:-1]
            a, b = ahead[:-1][both], (scores[1:] + back[1:])[both]
            joint = np.stack([np.zeros_like(a), b, a, a + b]) + model.moves.ravel()[:, None]
            joint = np.exp(joint - joint.max(0))
            joint /= joint.sum(0)
            seen = np.bincount((2 * y[:-1][both] + y[1:][both]).astype(int), minlength=4)
            move = (joint.sum(1) - seen).reshape(2, 2)
            move_squares += move**2
            model.moves -= 0.1 * move / np.sqrt(move_squares)
    x = summary(marginals(tok, model), tok.first)
    law = np.zeros(4)
    for _ in range(25):
        p = tn.sigmoid(x @ law)
        law -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(4), x.T @ (p - toxic) + 0.5 * law)
    model.law = law
    del tok, whole, part, batches, x
    tn.trim()
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, label: str = "toxic", most: int = MAX_TRAIN) -> Model:
    """A model of ``labels`` (doc_id and ``label``, 0 or 1) on at most about ``most`` documents, and MAX_BYTES of text, for which ``usable`` (of doc_id) holds.

    Null ids and labels teach nothing; neither do labels without a document. Repeated rows count as often as they stand there. Rows are
    taken in order of id, label and text, so that reruns train the same model.
    """
    return train(*training_rows(docs, labels, usable, label, 32, most, MAX_BYTES))


SPAN = "array<struct<start:bigint,stop:bigint>>"


def tag(df: DataFrame, model: Model, *, text: str = "text", keep_text: bool = False, score: str = "score", spans: str = "spans") -> DataFrame:
    """``df`` (its text left out, unless ``keep_text``) with ``score`` and ``spans``, the code points of each run of toxic words.

    The score is the probability that the document is toxic, from its words' marginals; empty and null texts get the score of no words and no
    spans. Input columns named like an output are replaced; ``score`` and ``spans`` name the outputs.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    others = [c for c in df.columns if c.lower() not in (score.lower(), spans.lower()) and (keep_text or c.lower() != text.lower())]
    schema = df.select(*[F.col(quoted(c)) for c in others], F.lit(0.0).alias(score), F.lit(None).cast(SPAN).alias(spans)).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [], []
            for _, _, data, offsets in tn.chunks(batch.column(len(others)), SIDE_BY_SIDE):
                tok = tokens(data, offsets)
                odds = marginals(tok, shared.value)
                scores.append(tn.sigmoid(summary(odds, tok.first) @ shared.value.law))
                found += offending(data, offsets, tok, odds)
            out = [pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), *out], [*others, score, spans])
        tn.trim()

    return df.select(*[F.col(quoted(c)) for c in others], F.col(quoted(text)).cast("string").alias("_text")).mapInArrow(tagged, schema)


def offending(data: np.ndarray, offsets: np.ndarray, tok: Tokens, odds: np.ndarray) -> list[list[dict]]:
    """Runs of neighbouring words that are likelier toxic than not, by document, in code points."""
    spans: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    bad = np.flatnonzero(odds > 0)
    if not len(bad):
        return spans
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    doc = np.searchsorted(tok.first, bad, side="right") - 1
    new = np.ones(len(bad), bool)
    new[1:] = (np.diff(bad) > 1) | (np.diff(doc) > 0)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(bad)) - 1
    for d, a, b in zip(doc[heads], bad[heads], bad[tails]):
        spans[d].append({"start": int(points[tok.start[a]] - points[offsets[d]]), "stop": int(points[tok.stop[b]] - points[offsets[d]])})
    return spans
