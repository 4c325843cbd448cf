"""Byte-level BPE: merges are replayed over the distinct words of a batch through an index from pair to positions."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from hushtable.llm.common import Remembered, over_texts


class Pairs(dict):
    """The rank that two neighbours merge to, or -1; each answer is found once and kept up to a bound."""

    def __init__(self, vocabulary: Vocabulary, most: int = 1_000_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, pair: tuple[int, int]) -> int:
        if len(self) > self.most:
            self.clear()
        of = self.vocabulary.bytes_of
        self[pair] = rank = self.vocabulary.ranks.get(of[pair[0]] + of[pair[1]], -1)
        return rank


class Vocabulary:
    """Ranks of byte strings, as a .tiktoken file lists them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        first = np.full((256, 256), -1, np.int64)
        for pair, rank in ranks.items():
            if len(pair) == 2:
                first[pair[0], pair[1]] = rank
        self.first = first
        self.pairs = Pairs(self)
        self.encoded = Remembered(lambda words: [np.array(ids, "<u4").tobytes() for ids in self.replay(words)], 800_000)

    def replay(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: every merge, in rank order, at all its positions over all words.

        A word that is a token as a whole is that token. `index` has the positions of each rank's pairs; a merge
        touches its two neighbours only. If a merge makes a pair of lower rank, that one goes first, as it would
        within a single word.
        """
        done: list = [None] * len(words)
        raws, spans, size = [], [], 0
        for k, word in enumerate(words):
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                done[k] = [whole]
            elif raw:
                raws.append(raw)
                spans.append((k, size, size := size + len(raw)))
            else:
                done[k] = []
        if not spans:
            return done
        codes = np.frombuffer(b"".join(raws), np.uint8)
        token = np.array(self.single, np.int64)[codes].tolist()
        starts, ends = (np.array([x[i] for x in spans]) for i in (1, 2))
        links = np.arange(1, size + 1)
        links[ends - 1] = -1
        after = links.tolist()
        links = np.arange(-1, size - 1)
        links[starts] = -1
        before = links.tolist()
        ranks = np.append(self.first[codes[:-1], codes[1:]], -1)
        ranks[ends - 1] = -1
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        kinds, first = np.unique(ranks[places], return_index=True)
        index = defaultdict(list, zip(kinds.tolist(), map(np.ndarray.tolist, np.split(places, first[1:]))))
        pairs = self.pairs
        order = list(index)
        heapq.heapify(order)
        while order:
            rank = heapq.heappop(order)
            places = sorted(index.pop(rank, ()))
            for k, i in enumerate(places):
                j = after[i]
                if j < 0 or token[i] < 0 or pairs[token[i], token[j]] != rank:
                    continue
                token[i], token[j] = rank, -1
                after[i] = right = after[j]
                left = before[i]
                lower = False
                if right >= 0:
                    before[right] = i
                    if (new := pairs[rank, token[right]]) >= 0:
                        if new not in index:
                            heapq.heappush(order, new)
                        index[new].append(i)
                        lower = new < rank
                if left >= 0 and (new := pairs[token[left], rank]) >= 0:
                    if new not in index:
                        heapq.heappush(order, new)
                    index[new].append(left)
                    lower |= new < rank
                if lower:
                    if places[k + 1 :]:
                        index[rank] += places[k + 1 :]
                        heapq.heappush(order, rank)
                    break
        for k, a, b in spans:
            done[k] = [t for t in token[a:b] if t >= 0]
        return done


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as file:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a})


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Encode every whole text, each match of `pattern` by itself, and decode the ids again.

    A null text counts as empty. Repeated rows are encoded row by row. Returns key, n_tokens, ids_sha256 (of the ids
    as little-endian 32-bit numbers), decoded_sha256, and with `ids` the ids as an array.
    """

    def start():
        import regex

        find, vocabulary = regex.compile(pattern).findall, load(path)

        def work(texts):
            rows = [find(t or "") for t in texts]
            distinct = list(set().union(*rows))
            code = dict(zip(distinct, vocabulary.encoded(distinct)))
            counts, sums, back, lists = [], [], [], []
            for words in rows:
                raw = b"".join(map(code.__getitem__, words))
                own = np.frombuffer(raw, "<u4").tolist()
                counts.append(len(own))
                sums.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(b"".join(map(vocabulary.bytes_of.__getitem__, own))).hexdigest())
                if ids:
                    lists.append(own)
            return [counts, sums, back, lists] if ids else [counts, sums, back]

        return work

    return over_texts(docs, [key], text, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids, start)
