"""Fill-in-middle: cut a text at two ranks of its units and put the middle last, in constant memory besides the text."""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtable.llm.common import over_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One code point, whatever it is.
CODE_POINT = r"(?s:.)"


class Matches:
    """A lazy iterator over the matches of a pattern, from left to right, that can be told to pass many at once.

    Adjacent matches are found in leaps, by one anchored match of the pattern repeated, each repeat atomic, so that they are
    the very matches that one search after the other would find. Where none of the leaps fits, as many single steps are taken
    before they are tried again. All that is kept is a place in the text.
    """

    LEAPS = (1024, 32)

    def __init__(self, unit: str):
        self.one, self.leaps = re.compile(unit), [(k, re.compile(f"(?>{unit}){{{k}}}")) for k in self.LEAPS]
        if self.one.match(""):
            raise ValueError("a unit must not match an empty text")

    def advance(self, text: str, at: int, most: float = float("inf")) -> tuple[int, int]:
        """Pass `most` matches from a place on, or all: how many there were, and where the last one ends."""
        passed = 0
        while passed < most:
            for k, leap in self.leaps:
                while passed + k <= most and (found := leap.match(text, at)):
                    passed, at = passed + k, found.end()
            step = 0
            for found in islice(self.one.finditer(text, at), int(min(self.LEAPS[0], most - passed))):
                step, at = step + 1, found.end()
            passed += step
            if step < self.LEAPS[0]:
                break
        return passed, at


def places(units: Matches, text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the unit of rank `first`, and then that of rank `second`, ends; rank 0 ends at the start."""
    a = units.advance(text, 0, first)[1]
    return a, units.advance(text, a, second - first)[1]


def draws(key: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of `1:` and the id; a null id draws as if it were empty."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CODE_POINT, rate: int = 90, spm: int = 20, keep: tuple = ()) -> DataFrame:
    """Each text as plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).

    Units are the matches of `unit` from left to right; what lies between matches goes with the unit after it, what follows
    the last cut with the suffix. The draws depend on the id alone: rows that share an id and text come out alike. Plain are
    empty texts, texts that hold a mark already, and 100 - `rate` percent of the rest; `spm` percent of the others are spm.
    A null text is empty. No unit is ever stored: one pass counts them, a second stops at the later cut.
    Returns key, the columns `keep`, n, form, prefix_chars, middle_chars (null if plain) and output.
    """
    h = draws(key)
    form = F.when(h[2] % 100 >= rate, "p").when(h[3] % 100 < spm, "s").otherwise("m")
    # the draws go in front of the text: it is the one column that the tasks take out of Arrow
    framed = F.concat(*[F.lpad(x.cast("string"), 10, "0") for x in h[:2]], form, F.coalesce(F.col(text), F.lit("")))
    given = docs.select(key, *keep, framed.alias("_framed"))

    def start():
        units = Matches(unit)

        def cut(framed):
            form, whole = framed[20], framed[21:]
            n = units.advance(whole, 0)[0]
            if form == "p" or not whole or any(mark in whole for mark in (PREFIX, SUFFIX, MIDDLE)):
                return n, "plain", None, None, whole
            a, b = places(units, whole, *sorted(int(framed[i : i + 10]) % (n + 1) for i in (0, 10)))
            if form == "s":
                return n, "spm", a, b - a, "".join((SUFFIX, whole[b:], PREFIX, whole[:a], MIDDLE, whole[a:b]))
            return n, "psm", a, b - a, "".join((PREFIX, whole[:a], SUFFIX, whole[b:], MIDDLE, whole[a:b]))

        return lambda texts: list(zip(*map(cut, texts)))

    return over_texts(given, [key, *keep], "_framed", "n long, form string, prefix_chars long, middle_chars long, output string", start)


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that an output was made from. Marks occur once each in what isn't plain: a text that holds one stays plain,
    and none can arise where a part meets a mark, as `<` only begins one."""
    out = F.col(output)
    behind = lambda mark, until: F.substring_index(F.substring_index(out, until, 1) if until else out, mark, -1)
    psm = F.concat(behind(PREFIX, SUFFIX), behind(MIDDLE, None), behind(SUFFIX, MIDDLE))
    spm = F.concat(behind(PREFIX, MIDDLE), behind(MIDDLE, None), behind(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
