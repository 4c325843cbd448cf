"""Token counts: huge texts are encoded in overlapping chunks and spliced where both encodings provably agree."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from hushtable.llm.common import over_texts

#: A boundary must lie so far before a chunk's end that no added token can be cut between them.
MARGIN = 64


@lru_cache(maxsize=4)
def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def starts(encoding, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens begin, as offsets into the whole text, and the number of the token that begins there."""
    words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
    first = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(words))
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    at = np.flatnonzero(new)
    return first[at] + offset, at


def spliced_ids(tokenizer, text: str, chunk: int, overlap: int) -> list[int]:
    """The ids of a whole text from overlapping chunks.

    Pre-tokens are found from left to right without looking back, so what follows a pre-token boundary depends only
    on the text after it. A boundary of the next chunk that the correct chunk before it has too, away from its end,
    is one of the whole text: from there the next chunk is right as well. If the chunks share no boundary, the
    overlap doubles, and then the chunk, until they do or one chunk holds the rest.
    """
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    out: list[int] = []
    begin, end = 0, min(len(text), chunk)
    now, take = encode(begin, end), 0
    while end < len(text):
        here, at = starts(now, begin)
        wide, found = overlap, None
        while True:
            back = max(begin, end - wide)
            ahead = encode(back, until := min(len(text), back + wide + chunk))
            there, there_at = starts(ahead, back)
            both, i, j = np.intersect1d(here, there, return_indices=True)
            ok = (both <= end - MARGIN) & (both > begin) & (at[i] >= take)
            if ok.any():
                k = np.flatnonzero(ok)[-1]
                found = at[i[k]], there_at[j[k]]
                break
            if back == begin:
                break
            wide *= 2
        if found:
            out += now.ids[take : found[0]]
            begin, end, now, take = back, until, ahead, found[1]
        else:  # nothing aligns within this chunk: encode it anew, longer
            keep = here[np.searchsorted(at, take)] if len(at) else begin
            begin, end = int(keep), min(len(text), end + 2 * (end - begin))
            now, take = encode(begin, end), 0
    return out + now.ids[take:]


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 1024, huge: int = 32_768, overlap: int = 1024) -> DataFrame:
    """Tokens of every whole text by the tokenizer file at `path`, without added special tokens.

    A null text counts as empty: 0 bytes, 0 tokens. Texts over `huge` characters are encoded in chunks of that size.
    Repeated rows and ids are counted row by row. Returns key, n_bytes, n_tokens, over_limit.
    """

    def start():
        tokenizer = load(path)

        def work(texts):
            texts = [t or "" for t in texts]
            n = np.zeros(len(texts), np.int64)
            small = [i for i, t in enumerate(texts) if len(t) <= huge]
            for at in range(0, len(small), 256):
                rows = small[at : at + 256]
                n[rows] = [len(e) for e in tokenizer.encode_batch_fast([texts[i] for i in rows], add_special_tokens=False)]
            for i in set(range(len(texts))) - set(small):
                n[i] = len(spliced_ids(tokenizer, texts[i], huge, overlap))
            return [len(t.encode()) for t in texts], n, n > limit

        return work

    return over_texts(docs, [key], text, "n_bytes long, n_tokens long, over_limit boolean", start)
