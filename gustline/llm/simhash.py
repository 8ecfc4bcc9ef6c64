"""SimHash near-duplicate components with pigeonring candidate filtering.

Fingerprints are cut into a ring of four 16-bit segments. If two differ in at
most 3 bits, the pigeonring principle gives a start segment from which every
chain of consecutive segments stays within its share of the budget: 0 bits over
one segment, 1 over two, 2 over three, 3 over all four. So a pair is found under
its start segment (equal) and one half of the next one (16 bits with at most one
difference have an equal half), and dropped at the first chain over budget,
before the full Hamming check.

Equal fingerprints are grouped first, so copies never meet each other. Within a
bucket no list of pairs is made: a task walks the bucket and returns, for each
linked member, one edge to the smallest member it is connected to. Large buckets
are dealt out as a grid of cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.common import col, replace_columns, stage, whole_text

BITS, SEGMENTS, MAX_DIFF = 64, 4, 3
SEED = 42
CELL = 8192  # members of one bucket that a task compares with one another, at most twice
# bits set in each 8-bit value, and for 16-bit values
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
ONES = np.add.outer(BYTE_BITS.sum(axis=1), BYTE_BITS.sum(axis=1)).reshape(-1).astype(np.uint8)


# -- fingerprints --------------------------------------------------------------
def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text as a signed integer; A-Z in
    lower case, words apart at ASCII white space, repeats included. Fewer words
    than a shingle: their whole sequence; none: zero."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        ends = np.cumsum([len(w) + 1 for w in words])
        begins = [0, *ends[:n - words_per_shingle].tolist()]
        stops = (ends[words_per_shingle - 1:] - 1).tolist()
        hashes = [digest(joined[b:e], SEED) for b, e in zip(begins, stops)]
    by_byte = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ BYTE_BITS for j in range(8)])
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, words_per_shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words_per_shingle) for t in texts], dtype="int64")
    return simhash(text)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# -- candidate buckets ----------------------------------------------------------
def bucket_keys() -> list[Column]:
    """Per start segment and half of the next one: both, the 16 and 8 bits."""
    def segment(i: int) -> Column:
        return F.shiftrightunsigned("fp", 16 * (i % SEGMENTS)).bitwiseAND(0xFFFF)
    out = []
    for i in range(SEGMENTS):
        for half in (0, 1):
            bits = F.shiftrightunsigned(segment(i + 1), 8 * half).bitwiseAND(0xFF)
            out.append(F.shiftleft(segment(i), 12).bitwiseOR(F.shiftleft(bits, 4)).bitwiseOR(F.lit(2 * i + half)))
    return out


def _within_budget(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which differences (xor) keep every chain from the start within budget."""
    ok = np.arange(len(x))
    spent = np.zeros(len(x), dtype=np.uint8)
    for step in range(1, SEGMENTS):
        turn = (16 * ((start[ok] + step) % SEGMENTS)).astype(np.uint64)
        spent = spent + ONES[((x[ok] >> turn) & np.uint64(0xFFFF)).astype(np.int64)]
        keep = spent <= MAX_DIFF * (step + 1) // SEGMENTS
        ok, spent = ok[keep], spent[keep]
    keep = np.zeros(len(x), dtype=bool)
    keep[ok] = True
    return keep


def link_cells(key: np.ndarray, group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member connected with it) of whole groups, given
    with equal ``group`` numbers next to each other."""
    n = len(fp)
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, n)
    end = np.repeat(ends, np.diff(ends, prepend=0))
    raw, start = fp.view(np.uint64), (key & 15) >> 1
    root = np.arange(n)
    members: dict[int, list[int]] = {}  # of roots with more than one
    at = np.arange(n)
    d = 1
    while True:
        at = at[at + d < end[at]]
        if not len(at):
            break
        apart = at[root[at] != root[at + d]]
        if len(apart):
            for i in apart[_within_budget(raw[apart] ^ raw[apart + d], start[apart])].tolist():
                a, b = int(root[i]), int(root[i + d])
                if a != b:
                    mine, theirs = members.pop(a, [a]), members.pop(b, [b])
                    if len(mine) < len(theirs):
                        mine, theirs, a = theirs, mine, b
                    root[theirs] = a
                    mine += theirs
                    members[a] = mine
        d += 1
    sides = [np.array(m) for m in members.values()]
    if not sides:
        none = np.empty(0, dtype=np.int64)
        return none, none
    low = np.concatenate([np.full(len(m), fp[m].min()) for m in sides])
    own = fp[np.concatenate(sides)]
    return own[own != low], low[own != low]


def _edges(fps: DataFrame) -> DataFrame:
    """a, b: edges that connect all fingerprints at most MAX_DIFF bits apart."""
    keyed = fps.select("fp", F.explode(F.array(*bucket_keys())).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cells = (keyed.join(shared, "key")
             .withColumn("m", F.ceil(F.col("n") / CELL).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, m - 1)")))
             .select("key", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "fp"))
    cells = cells.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v")
    names = ["a", "b"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.int64) for _ in range(4)]
        for batch in batches:
            cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)])
                    for h, c in zip(held, batch.columns)]
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            whole = int(change[-1]) if len(change) else 0  # the last cell may go on
            held = [c[whole:] for c in cols]
            if whole:
                yield from run([c[:whole] for c in cols], change[:-1])
        if len(held[0]):
            change = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
            yield from run(held, change)

    def run(cols, change):
        group = np.zeros(len(cols[0]), dtype=np.int64)
        group[change] = 1
        a, b = link_cells(cols[0], np.cumsum(group), cols[3])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=names)

    return cells.mapInArrow(link, "a long, b long").distinct()


# -- connected components --------------------------------------------------------
def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the smallest node reachable) for every node of the edges
    (a, b), by alternating large-star and small-star steps (no neighbour list is
    gathered; each step's edges are written, so a lost executor costs one step)."""
    def sides(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))

    def hang(e: DataFrame) -> DataFrame:
        """Every neighbour of u above the smallest of all goes to that one."""
        least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return e.join(least, "u")

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a <> b").distinct(), name)
    before = state(edges)
    while True:
        large = hang(sides(edges)).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = hang(down)
        small = (small.select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .union(small.select("u", "m")).filter("a <> b").distinct())
        edges = stage(small, name)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words_per_shingle: int = 3) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` (the
    smallest id reachable over fingerprints at most 3 bits apart) of every row.

    NULL text is an empty text; texts without words have fingerprint zero and
    link like any other. A row with a NULL id is labelled like its copies
    (NULL if no linked row has an id); repeated rows are rows of their own;
    an empty table gives no rows; other columns are left out.
    """
    own = stage(docs.select(col(id_col).alias("id"),
                            fingerprint_column(whole_text(text_col), words_per_shingle).alias("fp")), "simhash")
    fps = stage(own.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = connected_components(_edges(fps.select("fp")), "simhash-links")
    rooted = (fps.join(roots, fps["fp"] == roots["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # the smallest id of each component that has more than one fingerprint
    linked = stage(rooted, "simhash-roots")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    label = linked.join(least, "root").select("fp", "component_id")
    return own.join(label, "fp").select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"),
                                        "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             words_per_shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the
    smallest id. Of repeated rows of that id the one with the smallest content
    hash stays; rows with a NULL id stay only where no linked row has an id,
    one per component. Columns and their order are those of ``docs``."""
    columns = [col(c) for c in docs.columns]
    # 128 bits of the whole row: one column that isn't NULL, so the rows are dealt
    # out once, for the join and for the choice among repeated rows
    parts = [F.xxhash64(*columns), F.xxhash64(*[c.isNull() for c in columns], *columns)]
    key = "_row_key"
    while key in docs.columns:
        key = "_" + key
    found = near_duplicates(replace_columns(docs, {id_col: F.struct(
        col(id_col).isNull().alias("none"), col(id_col).alias("id"), parts[0].alias("hash"), parts[1].alias("more"))}),
        id_col, text_col, words_per_shingle)
    row = F.concat_ws(":", F.col(f"`{id_col}`.hash").cast("string"), F.col(f"`{id_col}`.more").cast("string"))
    kept = stage(found.filter(col(id_col) == F.col("component_id")).select(row.alias(key)).distinct(), "simhash-kept")
    named = docs.withColumn(key, F.concat_ws(":", *[p.cast("string") for p in parts]))
    one = Window.partitionBy(key).orderBy(F.lit(0))
    return (named.join(kept, key, "left_semi").withColumn("_n" + key, F.row_number().over(one))
            .filter(F.col("_n" + key) == 1).select(*columns))
