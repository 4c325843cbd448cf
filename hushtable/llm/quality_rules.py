"""Quality rules: a table of thresholds compiled into one projection of native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in a is that for it with as on are this be by from "
    "de la que el en los las un una es por con para del se le les et des du est dans pour au qui sur "
    "der die das und ist den von zu mit ein eine im auf für nicht dem"
).split()

#: (name, measure, least, most): a text passes a rule while its measure lies within the bounds; None is no bound.
RULES = (
    ("mean_word_chars", "mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", "symbols_per_word", None, 0.2),
    ("stop_words", "stop_words", 1, None),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
    ("bullet_lines", "bullet_line_ratio", None, 0.9),
    ("duplicate_lines", "dup_line_ratio", None, 0.3),
    ("alphabetic_words", "alphabetic_word_ratio", 0.6, None),
    ("exclamations", "exclamations_per_word", None, 0.5),
)

WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`, inside one expression."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Positions covered by windows of `width` words that a text has twice or more, the first included.

    Windows are told apart by a 64-bit hash of their words. Texts without a repeat, which one hash set shows,
    need no sort.
    """

    def covered(hashes):
        def ordered(pairs):
            same = lambda i, j: (j >= 0) & (j < F.size(pairs)) & (F.get(pairs, j)["h"] == F.get(pairs, i)["h"])
            starts = F.sort_array(
                F.transform(F.filter(F.transform(pairs, lambda e, i: F.struct(e["i"].alias("i"), (same(i, i - 1) | same(i, i + 1)).alias("twice"))), lambda e: e["twice"]), lambda e: e["i"])
            )
            return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(s, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, ordered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashes, covered))


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), rules: tuple = RULES) -> DataFrame:
    """Measure every text and judge it by the rules, natively.

    A null or empty text has no words and fails the base rule; its measures are 0. Repeated rows are judged one by one.
    Returns `keep`, the measures, base_failed, failed (names of the rules not passed) and kept.
    """
    clean = F.coalesce(F.col(text), F.lit(""))

    def measure(words):
        lower = lambda w: F.lower(w)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: lower(w).isin(STOP_WORDS))).cast("long").alias("stop_words"),
            F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("alphabetic_words"),
        )

    def lines_of(lines):
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("ellipsis"),
            F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]"))).alias("bullets"),
        )

    lines = F.filter(F.split(clean, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    out = docs.select(
        *keep,
        let(split_words(clean), measure).alias("_w"),
        let(lines, lines_of).alias("_l"),
        F.length(F.translate(clean, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(clean) - F.length(F.translate(clean, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(clean) - F.length(F.translate(clean, "!", ""))).cast("long").alias("n_exclamations"),
    )
    n, lines_n = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    measures = {
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "stop_words": F.col("stop_words"),
        "ellipsis_line_ratio": F.col("ellipsis") / lines_n,
        "bullet_line_ratio": F.col("bullets") / lines_n,
        "dup_line_ratio": F.col("n_dup_lines") / lines_n,
        "alphabetic_word_ratio": F.col("alphabetic_words") / n,
        "exclamations_per_word": F.col("n_exclamations") / n,
    }
    out = out.select(*keep, "_w.*", "_l.*", "word_chars", "n_symbols", "n_exclamations")
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    failed = []
    for name, of, least, most in rules:
        passed = F.lit(True)
        if least is not None:
            passed = passed & (measures[of] >= least)
        if most is not None:
            passed = passed & (measures[of] <= most)
        failed.append(F.when(~passed, F.lit(name)))
    out = out.withColumn("failed", F.array_compact(F.array(*failed)))
    return out.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), F.concat_ws(",", "failed").alias("failed"),
    )
