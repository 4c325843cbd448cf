"""Attribute-relation files: the header says names and kinds, the lines after it are rows, read by Spark in parts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTE = re.compile(r"""@attribute\s+('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\S+)\s+(.*)""", re.IGNORECASE)


def plain(word: str) -> str:
    """A name or value without its quotes."""
    word = word.strip()
    return re.sub(r"\\(.)", r"\1", word[1:-1]) if len(word) > 1 and word[0] == word[-1] and word[0] in "'\"" else word


def kind_of(text: str) -> tuple[str, list[str] | None]:
    """The Spark type of an attribute's kind, and its declared values if it has any."""
    text = text.split("%")[0].strip() if not text.startswith("{") else text.strip()
    if text.startswith("{"):
        inside = text[1 : text.rindex("}")]
        return "string", [plain(v) for v in re.findall(r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,]+)""", inside)]
    word = text.split()[0].lower()
    if word in ("numeric", "real"):
        return "double", None
    if word == "integer":
        return "long", None
    if word in ("string", "date"):
        return "string", None
    raise ValueError(f"an attribute of the kind {word} can't be read")


def read_arff(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The rows, and the declared values of each attribute that has them.

    Only header lines come to the driver. `?` is null, quotes are taken off, and a row that has a value too many or too few
    is refused when it is read. Sparse rows (in braces) are refused. Lines in a folder of files belong together only if
    each file has the header.
    """
    lines = spark.read.text(path).withColumn("value", F.trim("value"))
    header = [ATTRIBUTE.match(r[0]) for r in lines.where(F.lower("value").startswith("@attribute")).collect()]
    if not header or not all(header):
        raise ValueError(f"no attributes in {path}")
    kinds = {plain(m[1]): kind_of(m[2]) for m in header}
    rows = lines.where((F.col("value") != "") & ~F.substring("value", 1, 1).isin("@", "%"))
    sparse = F.when(F.col("value").startswith("{"), F.raise_error(F.lit("sparse rows can't be read"))).otherwise(F.col("value"))
    # double quotes become single ones, so that one quoting is left
    single = F.regexp_replace(sparse, r'"([^"]*)"', "'$1'")
    names = [f"_{i}" for i in range(len(kinds))]
    parsed = F.from_csv(single, ", ".join(f"{n} string" for n in [*names, "_more"]), {"quote": "'", "escape": "\\", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    rows = rows.select(parsed.alias("r")).select("r.*")
    short = F.col(names[-1]).isNull() | F.col("_more").isNotNull()
    rows = rows.select(*[F.when(short, F.raise_error(F.lit("a row has too many or too few values"))).otherwise(F.nullif(F.col(n), F.lit("?"))).cast(kind).alias(c) for n, (c, (kind, _)) in zip(names, kinds.items())])
    return rows, {c: values for c, (_, values) in kinds.items() if values is not None}
