"""Toxicity: every maximum-scoring segment of token log-odds, judged by the extreme values of clean text."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtable.llm.common import bounded_sample, over_texts, small_batches

TOKENS = re.compile(r"[^\W_]+")
#: What a token without evidence costs a segment.
COST = 0.25
#: Lengths of the word beginnings that have log-odds of their own.
BEGINNINGS = (4, 5, 6)
#: Folds of the cross-validation.
FOLDS = 3


def segments(places: list[int], gains: list[float], cost: float = COST) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last token), in linear time.

    `places` are the tokens with a gain of their own, below 0 too, in order; all others cost `cost`. Candidates are kept on
    a list with the running total at their left and right end; a new one swallows those that it improves on.
    """
    kept: list[list[float]] = []  # left total, right total, first, last, which kept one stood before with a smaller left total
    total, last = 0.0, -1
    for place, gain in zip(places, gains):
        total -= cost * (place - last - 1)
        last = place
        if gain <= 0:
            total += gain
            continue
        left, right, first = total, total + gain, place
        total = right
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j = int(kept[j][4])
            if j < 0 or kept[j][1] >= right:
                kept.append([left, right, first, place, j])
                break
            left, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(k[1] - k[0], int(k[2]), int(k[3])) for k in kept]


def evidence(scores, n: int, tail: tuple[float, float], times=1) -> float:
    """Sum over a text's segments of -log P(a clean text of its length has one as high), by the extreme-value law."""
    rate, scale = tail
    expected = np.log(scale * max(n, 1)) - rate * np.asarray(scores, float)  # log of how many a clean text has
    few = -expected
    some = np.maximum(-np.log(-np.expm1(-np.exp(np.minimum(np.maximum(expected, -20), 700)))), 0)
    return float((np.where(expected < -20, few, some) * times).sum())


def significant(segs: list[tuple[float, int, int]], n: int, tail: tuple[float, float], level: float) -> list[tuple[float, int, int]]:
    """The segments that a clean text of n tokens exceeds with a probability of `level` at most, by the extreme-value law."""
    rate, scale = tail
    return [s for s in segs if -np.expm1(-scale * max(n, 1) * np.exp(-rate * s[0])) <= level]


def forms(word: str) -> tuple:
    """A word and its beginnings, marked as such: a rare inflected word is judged by the surest of them."""
    return (word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k))


def value_of(word: str, lexicon: dict[str, float]) -> float | None:
    return max((lexicon[f] for f in forms(word) if f in lexicon), default=None)


def gains_of(text: str | None, lexicon: dict[str, float], values: Values | None = None):
    """Places and gains of a text's lexicon words, and its number of tokens; a word gains its log-odds wherever it stands."""
    tokens = TOKENS.findall(text.lower()) if text else []
    worth = values if values is not None else Values(lexicon)
    places, gains = [], []
    for i, value in enumerate(map(worth.__getitem__, tokens)):
        if value is not None:
            places.append(i)
            gains.append(value)
    return places, gains, len(tokens)


class Values(dict):
    """The value of each word met, found once, for a bounded number of words."""

    def __init__(self, lexicon: dict[str, float], most: int = 150_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> float | None:
        if len(self) > self.most:
            self.clear()
        self[word] = out = value_of(word, self.lexicon)
        return out


def train(
    docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = 6000, strength: float = 100.0, sure: float = 4.0,
    effects: tuple = (0.0, 0.5, 1.0, 1.5), most_words: int = 20_000, text: str = "text", key: str = "doc_id",
) -> dict | None:
    """Fit log-odds, the law of clean texts' scores, and the final calibration, by cross-validation within the labelled rows.

    Uses about `most` labelled documents of each class, chosen by a hash of their id and dealt into three folds. A word's
    log-odds compare the shares of toxic and clean documents that have it, under a Dirichlet prior of `strength`
    pseudo-documents spread as in both classes together. The lexicon holds the words whose log-odds differ from 0 by
    `sure` standard errors and by an effect of at least one of `effects` (the `most_words` surest). Every document is
    scanned with the lexicons that the other folds give; from these scores come the extreme-value law, the calibration,
    and the choice of the effect: the smallest whose log-loss is within a hundredth of the least. The model then has the
    log-odds of all folds. None without labels of both classes.
    """
    rows = labels.selectExpr(f"`{key}` as id", f"cast(`{target}` as int) as y").where("id is not null and y in (0, 1)").distinct()
    sample = docs.selectExpr(f"`{key}` as id", f"`{text}` as text").join(F.broadcast(bounded_sample(rows, "id", "y", most)), "id")
    sample = sample.select("text", "y", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(FOLDS)).cast("int").alias("fold"))
    classes = [(y, fold) for y in (0, 1) for fold in range(FOLDS)]
    names = [f"n{y}{fold}" for y, fold in classes]

    def count(frames):
        sums = {c: Counter() for c in classes}
        n = Counter()
        for frame in frames:
            for y, fold, t in zip(frame["y"], frame["fold"], frame["text"]):
                n[y, fold] += 1
                sums[y, fold].update({f for w in set(TOKENS.findall(t.lower())) for f in forms(w)} if t else ())
            if sum(map(len, sums.values())) > 300_000:
                yield flush(sums)
        yield flush(sums)
        yield pd.DataFrame({"word": [None]} | {name: [n[c]] for name, c in zip(names, classes)})

    def flush(sums):
        words = list(set().union(*sums.values()))
        out = pd.DataFrame({"word": pd.Series(words, dtype=object)} | {name: [sums[c][w] for w in words] for name, c in zip(names, classes)})
        for s in sums.values():
            s.clear()
        return out

    small_batches(docs.sparkSession)
    counts = sample.mapInPandas(count, "word string, " + ", ".join(f"{n} long" for n in names)).groupBy("word").agg(*[F.sum(n).alias(n) for n in names])
    counts = counts.where("word is null or " + " + ".join(names) + " >= 2").persist()
    total = counts.where("word is null").collect()
    if not total or any(not sum(total[0][f"n{y}{fold}"] for fold in range(FOLDS)) for y in (0, 1)):
        counts.unpersist()
        return None

    def log_odds(without):
        """Log-odds and their size in standard errors, from all folds but one."""
        used = [fold for fold in range(FOLDS) if fold != without]
        have = [sum((F.col(f"n{y}{fold}") for fold in used), F.lit(0)) for y in (0, 1)]
        n = [sum(total[0][f"n{y}{fold}"] for fold in used) for y in (0, 1)]
        prior = strength * (have[0] + have[1]) / max(sum(n), 1)
        b, a = (h + prior for h in have)
        odds = F.log(a / (n[1] + strength - a + 0.5)) - F.log(b / (n[0] + strength - b + 0.5))
        return F.when(have[0] + have[1] > 0, F.struct(odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")))

    found = counts.where("word is not null").select("word", *[log_odds(f).alias(f"f{f}") for f in range(FOLDS)], log_odds(None).alias("all"))
    surest = F.greatest(*[F.coalesce(F.abs(F.col(f"{c}.z")), F.lit(0.0)) for c in (*(f"f{f}" for f in range(FOLDS)), "all")])
    kept = found.where(surest > sure).orderBy(surest.desc(), "word").limit(most_words).collect()
    counts.unpersist()

    def lexicon(column, effect):
        return {r["word"]: r[column]["odds"] for r in kept if r[column] and abs(r[column]["z"]) > sure and abs(r[column]["odds"]) >= effect}

    held = docs.sparkSession.sparkContext.broadcast([[lexicon(f"f{f}", e) for e in effects] for f in range(FOLDS)])

    def scan(frames):
        values = [[Values(words, 50_000) for words in own] for own in held.value]
        for frame in frames:
            out = []
            for y, fold, t in zip(frame["y"], frame["fold"], frame["text"]):
                for k, own in enumerate(values[fold]):
                    places, gains, n = gains_of(t, own.lexicon, own)
                    at, times = np.unique(np.minimum([int(4 * s[0]) for s in segments(places, gains)], 1000), return_counts=True)
                    out.append((int(y), k, n, (at / 4 + 0.125).tolist(), times.tolist()))
            yield pd.DataFrame(out, columns=["y", "k", "n", "scores", "times"])

    # at most 1000 rounded scores a document and effect
    fits = sample.mapInPandas(scan, "y int, k int, n int, scores array<double>, times array<long>").toPandas()
    held.unpersist()
    tried = []
    for k, effect in enumerate(effects):
        own = fits[fits["k"] == k]
        y = own["y"].to_numpy(float)
        tail = extreme_value(own[own["y"] == 0])
        x = np.array([evidence(s, n, tail, np.asarray(times)) if len(s) else 0.0 for s, n, times in zip(own["scores"], own["n"], own["times"])])
        slope, constant = logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(slope * np.log1p(x) + constant, -30, 30)))
        tried.append((-float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), effect, tail, (slope, constant)))
    best = min(t[0] for t in tried)
    loss, effect, tail, line = next(t for t in tried if t[0] <= 1.01 * best + 1e-9)
    return {"lexicon": lexicon("all", effect), "tail": tail, "logistic": line, "effect": effect, "loss": loss}


def extreme_value(clean: pd.DataFrame) -> tuple[float, float]:
    """Rate and scale of E(segments above s in n tokens) = scale * n * exp(-rate * s), from clean texts' segments."""
    scores, times = (np.concatenate([np.asarray(s, float) for s in clean[c]]) if len(clean) else np.zeros(0) for c in ("scores", "times"))
    tokens = max(float(clean["n"].sum()), 1.0)
    if times.sum() < 5:
        return 1.0, 1.0 / tokens
    order = np.argsort(scores)
    least = scores[order][np.searchsorted(np.cumsum(times[order]), times.sum() / 2)]
    above = scores >= least
    rate = 1 / max(float(((scores - least) * times)[above].sum() / times[above].sum()), 0.1)
    return rate, float(times[above].sum()) / tokens * float(np.exp(rate * least))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and constant of a logistic fit to log(1 + x), by Newton steps with a small ridge."""
    z = np.stack([np.log1p(x), np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * np.array([w[0], 0])
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2) * [1, 1e-6], grad)
        w -= np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: dict | None, threshold: float = 0.7, text: str = "text", key: str = "doc_id", keep: tuple = (), spans: bool = False, level: float = 1.0) -> DataFrame:
    """Probability that a text is toxic, for every whole text.

    A null or empty text has no segment and gets the lowest probability; without a model all get 0. Returns key,
    `keep`, score, predicted (1 if score >= threshold), n_segments, and with `spans` the segments as (score, first, last
    token): all maximal segments whose score a clean text of that length reaches with a probability of `level` at most (1: every maximal segment).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = held.value
        values = Values(model["lexicon"] if model else {})

        def work(texts):
            scores, numbers, kept = [], [], []
            for t in texts:
                if model is None:
                    scores.append(0.0)
                    numbers.append(0)
                    kept.append([])
                    continue
                places, gains, n = gains_of(t, model["lexicon"], values)
                segs = segments(places, gains)
                slope, constant = model["logistic"]
                logit = slope * np.log1p(evidence([s[0] for s in segs], n, model["tail"])) + constant
                own = significant(segs, n, model["tail"], level)
                scores.append(float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))))
                numbers.append(len(own))
                kept.append([{"score": s, "first": a, "last": b} for s, a, b in own])
            predicted = (np.array(scores) >= threshold).astype(np.int32)
            return [scores, predicted, numbers, kept] if spans else [scores, predicted, numbers]

        return work

    made = "score double, predicted int, n_segments int" + ", segments array<struct<score:double,first:int,last:int>>" * spans
    return over_texts(docs, [key, *keep], text, made, start)
