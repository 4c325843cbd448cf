"""Rows from generated text: CSV lines among other lines, kept only where they fit the public schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtable.functions.bins import Schema, number

#: A header must name at least this share of the columns.
ENOUGH = 0.7


def parse_generated(texts: DataFrame, schema: Schema, text: str = "text", key: str | None = None) -> DataFrame:
    """A row for each line that fits, from all texts; with `key`, that column first.

    The header is a text's first line that names at least 0.7 of the columns; a text without one gives no row. A later
    line counts if it has as many fields as the header, a declared target label, numbers within their bounds and declared
    categories (`2.0` is read as `2`). Columns that the header lacks are null. Quotes are not read.
    """
    names = [*schema.numeric, *schema.categorical, schema.target]
    if key in names:
        raise ValueError(f"{key} is also a column of the schema")
    kept = [key] if key else []
    fields = lambda line: F.transform(F.split(line, ","), lambda s: F.trim(s))
    wanted = F.array(*[F.lit(c) for c in names])
    base = _once(texts, kept, lines=F.transform(F.split(F.col(text), "\r?\n"), fields))
    heads = F.transform("lines", lambda f: F.size(F.array_intersect(f, wanted)) >= len(names) * ENOUGH)
    base = _once(base, [*kept, "lines"], at=F.array_position(heads, True).cast("int")).where("at > 0")
    base = _once(base, [*kept, "lines", "at"], head=F.element_at("lines", F.col("at")))
    rows = base.select(*kept, "head", F.explode(F.slice("lines", F.col("at") + 1, F.size("lines"))).alias("fields")).where(F.size("fields") == F.size("head"))
    place = {c: F.array_position("head", c).cast("int") for c in names}
    read = lambda c: F.when(place[c] > 0, F.get("fields", place[c] - 1))
    rows = _once(rows, [*kept, "head"], **{c: read(c) for c in names})
    whole = lambda c, values: F.when(F.col(c).rlike(r"^-?\d+\.0+$") & ~F.col(c).isin(list(values)), F.regexp_replace(c, r"\.0+$", "")).otherwise(F.col(c))
    typed = {c: number(c) for c in schema.numeric} | {c: whole(c, v) for c, v in schema.categorical.items()}
    rows = _once(rows.where(F.col(schema.target).isin(schema.positive, schema.negative)), [*kept, "head"], **typed, **{schema.target: F.col(schema.target)})
    ok = F.lit(True)
    for c in [*schema.numeric, *schema.categorical]:
        edges = schema.numeric.get(c)
        fits = F.col(c).between(float(edges[0]), float(edges[-1])) if edges else F.col(c).isin(list(schema.categorical[c]))
        ok &= (place[c] == 0) | F.coalesce(fits, F.lit(False))
    return rows.where(ok).select(*kept, *names)


def _once(df: DataFrame, kept: list[str], **made: Column) -> DataFrame:
    """`kept` and new columns, each worked out once: the optimizer doesn't merge projections over a generator."""
    fresh = F.struct(*[value.alias(name) for name, value in made.items()])
    return df.select(*kept, F.inline(F.array(fresh)))
