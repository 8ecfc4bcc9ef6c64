"""Filter interaction audit: exact Shapley values by constrained least squares.

A set of filters is a coalition; its worth is the number of documents that at
least one of its filters removes. Which documents a coalition removes depends
only on the set of filters that each document fails, so one pass over the
texts, counted by that set, gives the table of all coalitions of a part. Every
figure of every order follows from it: a step's removals are the difference of
two coalitions, and the Shapley values solve the kernel-weighted least squares
problem under the efficiency constraint, in rational numbers.

The texts are read once and never shuffled: what moves is a hash, an id and the
failed filters. Copies are found by (hash, smallest id), so that the documents of
a large group of copies meet their group in as many tasks as there are ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import col, stage, whole_text

# The failure conditions of the audited filters.
FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
SYMBOLS = r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D of a text that isn't NULL."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    n, chars = F.size(words), F.char_length(text)
    capitals = chars - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < LEAST_WORDS,
            F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * LEAST_DISTINCT_PERCENT,
            capitals.cast("long") * 100 > chars.cast("long") * MOST_CAPITALS_PERCENT,
            text.rlike(SYMBOLS)]


def _mask(conditions: list[Column]) -> Column:
    """Bit n is set where condition n holds."""
    out = F.lit(0)
    for n, x in enumerate(conditions):
        out = out + F.when(x, 1 << n).otherwise(0)
    return out


def failed_sets(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: documents counted by the set of filters that
    they fail (bit n of ``mask``: filter n) and by their labels.

    NULL text is an empty text and copies other empty ones; a NULL part is the
    empty string. A document without an id copies none and none copies it. An
    id with several labels is good (toxic) if one of them says so; one without a
    label is neither.
    """
    text = F.col("t")
    marked = (docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"),
                          whole_text(text_col).alias("t"))
              .select("id", "part", F.unhex(F.sha2(text, 256)).alias("h"), _mask(text_failures(text)).alias("mask")))
    marked = stage(marked, "audit-marks")
    first = (marked.filter(F.col("id").isNotNull()).groupBy("h").agg(F.min("id").alias("id"))
             .select("h", "id", F.lit(True).alias("first")))
    own = labels.groupBy(col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return (marked.join(first, ["h", "id"], "left").join(own.filter(F.col("id").isNotNull()), "id", "left")
            .groupBy("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"),
                     F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
            .agg(F.count(F.lit(1)).alias("n")))


def shapley_rows(n: int) -> list[list[Fraction]]:
    """Row i: the weights with which the worths of the 2**n coalitions add up
    to filter i's Shapley value.

    The values x minimise the sum over all proper coalitions S of
    k(S) * (worth(S) - sum of x over S)**2, k the Shapley kernel, under
    sum(x) = worth(all). Its normal equations with the constraint's multiplier
    are solved for all worths at once.
    """
    everything = (1 << n) - 1
    size = [bin(s).count("1") for s in range(1 << n)]
    kernel = [Fraction(n - 1, comb(n, m) * m * (n - m)) if 0 < m < n else Fraction(0) for m in size]
    holds = [[(s >> i) & 1 for i in range(n)] for s in range(1 << n)]
    rows = []
    for i in range(n):
        left = [sum((kernel[s] * holds[s][i] * holds[s][j] for s in range(1 << n)), Fraction(0)) for j in range(n)]
        rows.append([*left, Fraction(1), *[kernel[s] * holds[s][i] for s in range(1 << n)]])
    rows.append([*[Fraction(1)] * n, Fraction(0), *[Fraction(int(s == everything)) for s in range(1 << n)]])
    for i in range(n + 1):  # Gauss-Jordan
        at = next(r for r in range(i, n + 1) if rows[r][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n + 1):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [r[n + 1:] for r in rows[:n]]


def coalition_table(cells: list[tuple[int, int]], n: int) -> list[int]:
    """Worth of every coalition: the documents that fail one of its filters."""
    return [sum(c for mask, c in cells if mask & s) for s in range(1 << n)]


def part_rows(cells: list[dict], names: str, weights: list[list[Fraction]]) -> Iterator[tuple]:
    """Every step of every order of the filters, for one part."""
    n = len(names)
    worth = coalition_table([(c["mask"], c["n"]) for c in cells], n)
    good = coalition_table([(c["mask"], c["n"]) for c in cells if c["good"]], n)
    toxic = coalition_table([(c["mask"], c["n"]) for c in cells if c["toxic"]], n)
    total, everything = sum(c["n"] for c in cells), (1 << n) - 1
    orders = factorial(n)
    value = [orders * sum(w * v for w, v in zip(row, worth)) for row in weights]
    if any(x.denominator != 1 for x in value) or sum(value) != orders * worth[everything]:
        raise ArithmeticError("Shapley values don't add up")
    for order in permutations(range(n)):
        word, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = worth[after] - worth[before]
            yield (word, step, total - worth[after], removed, worth[1 << i] - removed,
                   worth[everything] - worth[everything ^ 1 << i], good[after] - good[before],
                   toxic[after] - toxic[before], int(value[i]))
            before = after


def interactions(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """The audit from counted sets (``failed_sets``): per part, every order of
    the filters and every step its ``kept``, ``removed``, ``redundant`` (failing
    the filter, removed earlier), ``unique_fails`` (failing it only),
    ``good_lost``, ``toxic_lost`` and ``shapley`` (the filter's removals added
    up over all orders). Zeros are kept; no cells give no rows. A part's cells
    are at most 4 * 2**n rows, whatever the number of documents.
    """
    figures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    kinds = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
                       *[(f, pa.int64()) for f in figures]])

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shapley_rows(len(names))
        for batch in batches:
            for row in batch.to_pylist():
                out = list(zip(*part_rows(row["cells"], names, weights)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(out[0])), *[pa.array(v, f.type) for v, f in zip(out, list(kinds)[1:])]],
                    schema=kinds)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{f} bigint" for f in figures)
    return (cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
            .mapInArrow(audit, schema))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """The five filters over whole texts, audited; see ``failed_sets`` and
    ``interactions``. Repeated rows are documents of their own and don't copy
    each other; texts of any length are read whole; an empty table gives no
    rows; other columns are left out."""
    return interactions(failed_sets(docs, labels, id_col, text_col, part_col))
