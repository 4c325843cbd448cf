"""Language identification by unigram pieces, summing over all segmentations of every word."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtable.llm.common import Remembered, by_length, list_sums, materialize, bounded_sample, over_texts, prefix_hashes, slices, substring_hash, word_ids

WORDS = re.compile(r"[^\W\d_]+")
#: Probability of a single character that no piece covers.
UNKNOWN = 1e-7
#: Each step is multiplied by this, so that words of LONG characters stay within the range of a double; longer ones are
#: summed by logarithms.
SCALE, LONG = 1e3, 65


def letters(text: str) -> list[str]:
    """Runs of letters (Unicode categories L*) in lower case."""
    found = WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for word in found for part in "".join(c if c.isalpha() else " " for c in word).split()]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all lower-case pieces of letters, a table from hash to number (0: no piece), and the longest piece's length.

    The table has as many places a slot as its fullest slot needs, so that it leaves no piece out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sorted({p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)) == p.lower() and (p == "▁" or p.strip("▁").isalpha() and p.find("▁", 1) < 0)})
    hashes = np.zeros(len(pieces) + 1, np.uint64)
    for rows, points in by_length(pieces):
        hashes[rows + 1] = prefix_hashes(points)[:, -1]
    at = slot(hashes[1:]).astype(np.int64)
    order = np.argsort(at, kind="stable")
    fill = np.arange(len(at)) - np.searchsorted(at[order], at[order])
    table = np.zeros((SLOTS, int(fill.max(initial=0)) + 1), np.int32)
    table[at[order], fill] = order + 1
    seen = np.zeros(1 << SEEN, np.uint8)
    seen[thin(hashes[1:])] = 1
    return hashes, table, max(map(len, pieces), default=1), seen


SLOTS = 1 << 18
SEEN = 21


def thin(h):
    """The place of a hash in the small table that most strings that are no piece don't pass."""
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SEEN)


def slot(h):
    return ((h ^ (h >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def piece_numbers(prefixes: np.ndarray, at: int, length: int, known: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a piece at a place, and which one."""
    h = substring_hash(prefixes, at, length)
    hashes, table, _, seen = known
    rows = np.flatnonzero(seen[thin(h)])
    h = h[rows]
    places = table[slot(h)]
    out = np.zeros(len(h), np.int64)
    for k in range(table.shape[1]):
        out = np.where((hashes[places[:, k]] == h) & (places[:, k] > 0), places[:, k], out)
    return rows[out > 0], out[out > 0]


def pieces_at(prefixes: np.ndarray, at: int, length: int, known: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The same, where a single character that no piece covers counts as piece 0."""
    rows, numbers = piece_numbers(prefixes, at, length, known)
    if length > 1:
        return rows, numbers
    every = np.zeros(len(prefixes), np.int64)
    every[rows] = numbers
    return np.arange(len(prefixes)), every


def forward(points: np.ndarray, probability: np.ndarray, known: tuple, keep: bool = False):
    """Scaled probabilities of all prefixes, by language: sums over every way to split them into pieces.

    `probability` has a row for each piece, and a column for each language; row 0 is for characters that no piece covers.
    """
    prefixes = prefix_hashes(points)
    n, length = points.shape
    alpha = np.zeros((length + 1, n, probability.shape[1]))
    alpha[0] = 1
    found = {}
    for end in range(1, length + 1):
        for size in range(1, min(known[2], end) + 1):
            rows, numbers = pieces_at(prefixes, end - size, size, known)
            if len(rows):
                alpha[end, rows] += alpha[end - size, rows] * (probability[numbers] * SCALE**size)
                if keep:
                    found[end, size] = rows, numbers
    return (alpha, found) if keep else alpha[length]


def by_logarithms(points: np.ndarray, logs: np.ndarray, known: tuple):
    """The same sums for words of any length: log-probabilities of all prefixes, and the pieces found."""
    prefixes = prefix_hashes(points)
    n, length = points.shape
    alpha = np.full((length + 1, n, logs.shape[1]), -np.inf)
    alpha[0] = 0
    found = {}
    for end in range(1, length + 1):
        for size in range(1, min(known[2], end) + 1):
            rows, numbers = pieces_at(prefixes, end - size, size, known)
            if len(rows):
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - size, rows] + logs[numbers])
                found[end, size] = rows, numbers
    return alpha, found


def word_scores(words: list[str], probability: np.ndarray, known: tuple) -> np.ndarray:
    """Log-probability of each word by language. Each word begins with the mark of a word's start."""
    out = np.zeros((len(words), probability.shape[1]))
    for rows, points in by_length(["▁" + w for w in words]):
        for at in range(0, len(rows), 20_000):
            part = slice(at, at + 20_000)
            if points.shape[1] > LONG:
                out[rows[part]] = by_logarithms(points[part], np.log(probability.astype(float)), known)[0][-1]
            else:
                out[rows[part]] = np.log(np.maximum(forward(points[part], probability, known), 1e-300)) - points.shape[1] * np.log(SCALE)
    return out


def expected_pieces(words: list[str], counts: np.ndarray, probability: np.ndarray, known: tuple) -> tuple[np.ndarray, float]:
    """How often each piece is expected in the words, over all segmentations, forward and backward; and their log-likelihood."""
    seen, likely = [(np.zeros(0, np.int64), np.zeros(0))], 0.0
    for rows, points in by_length(["▁" + w for w in words]):
        length = points.shape[1]
        if length > LONG:
            logs = np.log(probability)
            alpha, found = by_logarithms(points, logs, known)
            beta = np.full((length + 1, len(points)), -np.inf)
            beta[length] = 0
            total = alpha[length, :, 0]
            for end, size in sorted(found, reverse=True):
                at, number = found[end, size]
                step = logs[number, 0] + beta[end, at]
                seen.append((number, counts[rows[at]] * np.exp(alpha[end - size, at, 0] + step - total[at])))
                beta[end - size, at] = np.logaddexp(beta[end - size, at], step)
            likely += float(counts[rows] @ total)
            continue
        alpha, found = forward(points, probability, known, True)
        beta = np.zeros((length + 1, len(points)))
        beta[length] = 1
        total = np.maximum(alpha[length, :, 0], 1e-300)
        likely += float(counts[rows] @ (np.log(total) - length * np.log(SCALE)))
        for end, size in sorted(found, reverse=True):
            at, number = found[end, size]
            step = probability[number, 0] * SCALE**size * beta[end, at]
            seen.append((number, counts[rows[at]] * alpha[end - size, at, 0] * step / total[at]))
            beta[end - size, at] += step
    numbers, shares = map(np.concatenate, zip(*seen))
    return np.bincount(numbers, shares, len(probability)), likely


def gathered(frames, rows: int):
    """Frames put together to about so many rows, as a few large matrices cost less than many small ones."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)


def train(docs: DataFrame, path: str, most_docs: int = 1500, most_rounds: int = 3, gain: float = 0.1, text: str = "text", key: str = "doc_id", lang: str = "lang") -> dict[str, np.ndarray]:
    """Piece probabilities of each language by expectation and maximisation, until a round adds less than `gain` to the
    mean log-likelihood of a word, `most_rounds` at most.

    Fitted on about `most_docs` labelled documents of each language, chosen by a hash of their id; their words are
    counted, and each round's expected counts summed, by Spark. Only (languages x pieces) numbers come to the driver.
    """
    labelled = docs.selectExpr(f"`{key}` as id", f"`{text}` as text", f"`{lang}` as lang").where("lang is not null and text is not null")
    sample = bounded_sample(labelled, "id", "lang", most_docs).select("lang", "text")

    def count(frames):
        for frame in frames:
            for part in slices(frame):
                found: dict = {}
                for own, t in zip(part["lang"], part["text"]):
                    found.setdefault(own, Counter()).update(letters(t))
                yield pd.DataFrame([(own, w, n) for own, c in found.items() for w, n in c.items()], columns=["lang", "word", "n"])

    words = materialize(sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(16, "lang", "word"))
    known = vocabulary(path)
    size = len(known[0])
    uniform = np.full((size, 1), 1 / size)
    uniform[0] = UNKNOWN
    model: dict[str, np.ndarray] = {}
    total = words.agg(F.sum("n")).first()[0] or 0
    last = -np.inf
    for _ in range(most_rounds):
        before = dict(model)

        def expect(frames):
            pieces = vocabulary(path)
            sums: dict = {}
            for frame in gathered(frames, 20_000):
                for own, part in frame.groupby("lang"):
                    p = before[own][:, None] if own in before else uniform
                    found, likely = expected_pieces(part["word"].tolist(), part["n"].to_numpy(float), p, pieces)
                    sums[own] = sums.get(own, 0) + np.append(found, likely)
            for own, s in sums.items():
                at = np.flatnonzero(s)
                yield pd.DataFrame({"lang": own, "piece": at, "n": s[at]})

        got = words.mapInPandas(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        model = {}
        likely = float(got.loc[got["piece"] == size, "n"].sum()) / max(total, 1)
        for own, part in got[got["piece"] < size].groupby("lang"):
            s = np.full(size, 0.1)
            s[part["piece"]] += part["n"]
            s[0] = 0
            model[own] = s / s.sum()
            model[own][0] = UNKNOWN
        if likely - last < gain:
            break
        last = likely
    return dict(sorted(model.items()))


def identify(docs: DataFrame, model: dict[str, np.ndarray], path: str, text: str = "text", key: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """The most probable language of every whole text, with its probability among the learned languages.

    A null text, one without a letter, and any text when no language was learned get `und` and 0. Ties go to the first
    language by name. Returns key, `keep`, lang_pred, score.
    """
    languages = np.array([*model, "und"], dtype=object)
    weights = docs.sparkSession.sparkContext.broadcast(np.stack(list(model.values()), 1).astype(np.float32) if model else None)

    def start():
        pieces, probability = vocabulary(path), weights.value
        scores = Remembered(lambda words: list(word_scores(words, probability, pieces).astype(np.float32)), 100_000)

        def work(texts):
            lists = [letters(t) if t and probability is not None else [] for t in texts]
            words, flat, lengths = word_ids(lists)
            best, score = np.full(len(texts), len(languages) - 1), np.zeros(len(texts))
            if words:
                total = list_sums(np.array(scores(words))[flat], lengths)
                some = lengths > 0
                share = np.exp(total - total.max(1, keepdims=True))
                best[some] = total.argmax(1)[some]
                score[some] = (1 / share.sum(1))[some]
            return languages[best].tolist(), score

        return work

    return over_texts(docs, [key, *keep], text, "lang_pred string, score double", start)
