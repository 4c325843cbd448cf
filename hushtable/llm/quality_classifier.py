"""Quality classifier: hashed word and character n-gram vectors, averaged per document, under a softmax."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtable.llm.common import Remembered, bounded_sample, by_length, list_sums, mix, over_texts, prefix_hashes, slices, substring_hash, word_ids

BUCKETS = 1 << 16
GRAMS = (3, 4)


def features(words: list[str], buckets: int = BUCKETS):
    """Buckets (from 2 on) of each word itself and of the character n-grams of <word>: arrays (word number, bucket)."""
    rows_of, bucket_of = [], []
    for rows, points in by_length([f"<{w}>" for w in words]):
        prefixes = prefix_hashes(points)
        length = points.shape[1]
        parts = [substring_hash(prefixes, 0, length) ^ np.uint64(0x5BD1E995)]
        parts += [substring_hash(prefixes, at, n) for n in GRAMS for at in range(length - n + 1)]
        rows_of += [rows] * len(parts)
        bucket_of += [np.maximum(2, (mix(h) & np.uint64(buckets - 1)).astype(np.int64)) for h in parts]
    return (np.concatenate(rows_of), np.concatenate(bucket_of)) if rows_of else (np.zeros(0, int), np.zeros(0, int))


#: Buckets of two marks of word n-grams: a word that repeats the one before it, and three words that the text had before.
SAME, AGAIN = 0, 1
#: Added to a document's number of n-grams before averaging, so that a few words alone decide little.
FEW = 20.0


def marks(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each mark is in each text, whose word numbers follow one another in `flat`."""
    out = np.zeros((len(lengths), 2))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    if len(flat) > 1:
        same = (flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])
        out[:, SAME] = np.bincount(doc[1:][same], minlength=len(lengths))
    ends = np.cumsum(lengths)
    for i in np.flatnonzero(lengths > 3):
        own = flat[ends[i] - lengths[i] : ends[i]].astype(np.uint64)
        grams = mix(mix(mix(own[:-2]) + own[1:-1]) + own[2:])
        out[i, AGAIN] = len(grams) - len(np.unique(grams))
    return out


def descend(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int = 12, epochs: int = 5, rate: float = 0.5, seed: int = 7, buckets: int = BUCKETS):
    """Stochastic gradient descent over (buckets, shares) of documents; returns the vectors and the softmax weights."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / size, 1 / size, (buckets, size)).astype(np.float32)
    weights = np.zeros((size + 1, 2), np.float32)
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            step = rate * (1 - steps / total)
            steps += 1
            at, share = bags[i]
            mean = np.append(share @ vectors[at], np.float32(1))
            logits = mean @ weights
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weights[:-1] @ p
            weights -= step * np.outer(mean, p)
            # a document's vectors move by their shares, scaled so that long texts learn as fast as short ones
            vectors[at] -= (step / max(0.02, float(share @ share)) * share)[:, None] * back
    return vectors, weights


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = 700, text: str = "text", key: str = "doc_id") -> np.ndarray | None:
    """Fit on about `most` labelled documents of each class, chosen by a hash of their id.

    The sample's bags of buckets (each no longer than the number of buckets) come to the driver, where numpy trains.
    Returns one log-odds for each bucket, then the constant, or None if there is no labelled document of both classes.
    Equal labels of an id count once, null labels not at all; an id with both labels counts for both.
    """
    rows = labels.selectExpr(f"`{key}` as id", f"cast(`{target}` as int) as y").where("id is not null and y in (0, 1)").distinct()
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    sample = docs.selectExpr(f"`{key}` as id", f"`{text}` as text").join(F.broadcast(bounded_sample(rows, "id", "y", most)), "id")

    def bag(frames):
        for frame in frames:
            for part in slices(frame):
                out = []
                for t in part["text"].fillna(""):
                    words, flat, lengths = word_ids([t.split()])
                    row, bucket = features(words)
                    times = np.bincount(flat, minlength=len(words))
                    all_ = np.bincount(bucket, times[row], BUCKETS)
                    all_ = all_.astype(float)
                    all_[[SAME, AGAIN]] = marks(flat, lengths)[0]
                    at = np.flatnonzero(all_)
                    out.append((at.astype("<u4").tobytes(), (all_[at] / (all_.sum() + FEW)).astype("<f4").tobytes()))
                yield pd.DataFrame(out, columns=["at", "share"]).assign(id=part["id"].to_numpy(), y=part["y"].to_numpy())

    kind = docs.schema[key].dataType.simpleString()
    got = sample.mapInPandas(bag, f"at binary, share binary, id {kind}, y int").toPandas().sort_values(["id", "y", "at"], kind="stable")
    y = got["y"].to_numpy()
    if len(set(y)) < 2:
        return None
    bags = [(np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(s, "<f4")) for a, s in zip(got["at"], got["share"])]
    vectors, weights = descend(bags, y)
    odds = vectors @ (weights[:-1, 1] - weights[:-1, 0])
    constant = float(weights[-1, 1] - weights[-1, 0])
    # the classes were sampled alike; give back the share that they have among all labels
    shift = np.log(counts[1] / counts[0]) - np.log(max((y == 1).sum(), 1) / max((y == 0).sum(), 1))
    return np.append(odds, constant + shift).astype(np.float32)


def score(docs: DataFrame, model: np.ndarray | None, threshold: float = 0.3, text: str = "text", key: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """Probability of class 1 for every whole text.

    A null or empty text has no n-grams and gets the constant's probability; without a model all get 0.5.
    Returns key, `keep`, score, predicted (1 if score >= threshold).
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        odds = weights.value

        def sums(words):
            row, bucket = features(words)
            return np.stack([np.bincount(row, odds[bucket], len(words)), np.bincount(row, minlength=len(words))], 1).astype(np.float32).tolist()

        value = Remembered(sums, 100_000)

        def work(texts):
            logit = np.zeros(len(texts))
            if odds is not None:
                words, flat, lengths = word_ids([t.split() if t else [] for t in texts])
                logit += odds[-1]
                if words:
                    total = list_sums(np.array(value(words), float)[flat], lengths)
                    found = marks(flat, lengths)
                    logit += (total[:, 0] + found @ odds[:2]) / (total[:, 1] + found.sum(1) + FEW)
            p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            return p, (p >= threshold).astype(np.int32)

        return work

    return over_texts(docs, [key, *keep], text, "score double, predicted int", start)
