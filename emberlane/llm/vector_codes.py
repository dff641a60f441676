"""Vector code compression: product codebooks refined in rounds, each part assigned through a vantage-point tree."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.llm.common import BROADCAST_ROWS, spread_join, stored
from emberlane.llm.topk import scaled

#: Vectors that are stored and coded together; rows of one label from which on they are dealt to many tasks.
CHUNK, HOT = 8192, 100_000
#: Entries that a tree's leaf compares one by one; more than the relative error of a root, a sum or a product of doubles.
LEAF, SLACK = 4, 1e-12


@dataclass
class _Node:
    """A vantage entry, and for each half of the other entries the range of their distances from it, rounded outwards."""

    vantage: int
    near: _Node | np.ndarray
    far: _Node | np.ndarray
    bounds: tuple[tuple[float, float], tuple[float, float]]
    middle: float


def vantage_tree(entries: np.ndarray, some: np.ndarray | None = None) -> _Node | np.ndarray:
    """A vantage-point tree over the rows of ``entries``; small sets stay lists of row numbers."""
    some = np.arange(len(entries)) if some is None else some
    if len(some) <= LEAF:
        return some
    away = np.sqrt(((entries[some[1:]] - entries[some[0]]) ** 2).sum(1).astype(float))
    order = np.argsort(away, kind="stable")
    half = len(order) // 2
    cut = order[:half], order[half:]
    bounds = tuple((away[c].min() * (1 - SLACK), away[c].max() * (1 + SLACK)) for c in cut)
    near, far = (vantage_tree(entries, np.sort(some[1:][c])) for c in cut)
    return _Node(int(some[0]), near, far, bounds, float(away[order[half]]))


def nearest(entries: np.ndarray, tree: _Node | np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``x`` the nearest entry (ties to the lower index) and its squared distance, all in integers.

    Branch and bound: a half is left out only where its nearest possible distance, rounded down, exceeds the best found so
    far, rounded up; one that may tie is visited. What is visited is compared by exact integer distances.
    """
    best = np.full(len(x), np.iinfo(np.int64).max)
    at = np.full(len(x), len(entries))

    def compare(rows: np.ndarray, entry: int) -> np.ndarray:
        gap = x[rows] - entries[entry]
        d = np.einsum("ij,ij->i", gap, gap)
        wins = (d < best[rows]) | ((d == best[rows]) & (entry < at[rows]))
        best[rows[wins]], at[rows[wins]] = d[wins], entry
        return d

    def visit(node: _Node | np.ndarray, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for entry in node:
                compare(rows, int(entry))
            return
        away = np.sqrt(compare(rows, node.vantage).astype(float))

        def half(k: int, some: np.ndarray) -> None:
            low, high = node.bounds[k]
            least = np.maximum(away[some] * (1 - SLACK) - high, low - away[some] * (1 + SLACK))
            may = least <= np.sqrt(best[rows[some]].astype(float)) * (1 + SLACK)
            visit((node.near, node.far)[k], rows[some[may]])

        inside = away < node.middle
        for first, some in ((0, np.flatnonzero(inside)), (1, np.flatnonzero(~inside))):
            half(first, some)
            half(1 - first, some)

    visit(tree, np.arange(len(x)))
    return at, best


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, x) in chunks: ids, labels and one blob of integers; ``most`` is the largest component, ``dim`` its length."""
    for batch in batches:
        vectors = batch.column(2)
        sizes = np.diff(vectors.offsets.to_numpy())
        values = vectors.flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for dim in np.unique(sizes):  # one blob for each length; more than one length raises later
            rows = np.flatnonzero(sizes == dim)
            for a in range(0, len(rows), CHUNK):
                some = rows[a : a + CHUNK]
                x = values[(ends[some][:, None] + np.arange(dim)).ravel()]
                most = float(np.abs(x.astype(float)).max(initial=0))
                one = pa.array([0, len(some)], pa.int32())
                lists = [pa.ListArray.from_arrays(one, batch.column(c).take(pa.array(some))) for c in (0, 1)]
                cols = [*lists, pa.array([len(some)], pa.int32()), pa.array([int(dim)], pa.int32()), pa.array([most]), pa.array([x.astype("<i8").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["ids", "labels", "rows", "dim", "most", "x"])


def _opened(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for r in range(batch.num_rows):
            x = np.frombuffer(batch.column("x")[r].as_buffer(), dtype="<i8")
            yield batch, r, x.reshape(batch.column("rows")[r].as_py(), parts, -1)


def _moved(books: list[np.ndarray]) -> Callable:
    """One row for each part and entry that a task's vectors use: their number and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [vantage_tree(b) for b in books]
        sums = [np.zeros_like(b) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        for _, _, x in _opened(batches, len(books)):
            for p, book in enumerate(books):
                at, _ = nearest(book, trees[p], x[:, p])
                for e in np.unique(at):
                    mine = x[at == e, p]
                    sums[p][e] += mine.sum(0)
                    counts[p][e] += len(mine)
        used = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c)]
        if used:
            cols = [pa.array([u[k] for u in used], pa.int32()) for k in (0, 1)]
            cols += [pa.array([int(counts[p][e]) for p, e in used], pa.int64())]
            cols += [pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", "total"])

    return run


def _coded(books: list[np.ndarray], names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [vantage_tree(b) for b in books]
        for batch, r, x in _opened(batches, len(books)):
            found = [nearest(book, trees[p], x[:, p]) for p, book in enumerate(books)]
            digits = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            code = [row.tobytes().hex() for row in digits]
            error = np.sum([d for _, d in found], axis=0)
            ids, labels = (batch.column(c).slice(r, 1).flatten() for c in ("ids", "labels"))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code), pa.array(error)], names=names)

    return run


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal text by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096,
) -> DataFrame:
    """One row per vector: ``id_col``, code, error, label_error, codebooks_sha256.

    Components become ``floor(factor * x)``; vectors are cut into ``parts`` equal consecutive parts, each with a codebook of
    at most ``entries`` (256 at most) integer vectors, first those of the smallest ids, then in each round the floored means
    of what is assigned to them; unused entries stay. Vectors are stored once as integer chunks; a round is one pass that
    sends at most ``parts * entries`` rows of counts and sums from each task, merged by Spark, and only the codebooks, whose
    size parameters and dimension fix, reach the driver. Nearest entries are found in vantage-point trees (:func:`nearest`),
    exactly. ``label_error`` sums the error over equal labels, nulls together; rows of labels with many rows are dealt to many
    tasks.

    Vectors that are null or hold null or non-finite components take no part. A null id is coded but starts no codebook
    entry; of rows that repeat an id, the smaller vector is the first; fewer kept rows than ``entries`` make smaller
    codebooks; without any the result is empty. Vectors of several lengths, a length that ``parts`` doesn't divide, or
    components too large for exact 64-bit distances raise.
    """
    spark = vectors.sparkSession
    named = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), scaled(F.col(f"`{vector_col}`"), factor).alias("x")
    )
    kept = named.where("x is not null")
    kinds = {c: named.schema[c].dataType for c in ("id", "label")}
    blob = f"ids array<{kinds['id'].simpleString()}>, labels array<{kinds['label'].simpleString()}>, rows int, dim int, most double, x binary"
    chunks = stored(kept.mapInArrow(_packed, blob))
    shortest, longest, most = chunks.agg(F.min("dim"), F.max("dim"), F.max("most")).first()
    out = T.StructType([T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if shortest is None:
        coded, digest = spark.createDataFrame([], out), ""
    else:
        if shortest != longest or longest % parts or entries > 256:
            raise ValueError(f"vectors need one length that {parts} divides and at most 256 entries: lengths {shortest} to {longest}")
        if 4.0 * max(1, longest) * most**2 >= 2**62:
            raise ValueError(f"a component of {most} at {longest} dimensions is beyond exact 64-bit distances")
        first = kept.where("id is not null").orderBy("id", "x").limit(entries).collect()
        first = first or kept.orderBy("x").limit(entries).collect()
        start = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, -1)
        books = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
        width = books[0].shape[1]
        for _ in range(rounds):
            moved = chunks.mapInArrow(_moved(books), "part int, entry int, n long, total array<long>")
            sums = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
            for r in moved.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
                books[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
        digest = codebooks_digest(books)
        coded = stored(chunks.mapInArrow(_coded(books, out.fieldNames()), out))
    keyed = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    totals = stored(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    sums = totals.drop("n")
    if totals.count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(sums), "key")
    else:
        joined = spread_join(keyed, sums, "key", totals.where(F.col("n") > HOT).select("key"), "inner")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
