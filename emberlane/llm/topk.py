"""Exact top-k by inner product: norm buckets, pruned by coordinate or length from local cosine thresholds, then verified."""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlane.llm.common import if_small, stored

#: Vectors of a bucket and queries of a block, at most: a task holds one of each at a time.
BUCKET, BLOCK = 4096, 512
#: Blocks that share one copy of a bucket, about; dimensions whose first buckets (2 MiB each in 64 dimensions) are broadcast at most.
SHARE, FEW = 32, 8
#: From this local cosine threshold on a query looks up candidates by its largest coordinate, below it by length.
STEEP = 0.8


def scaled(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of each component as long; null where the vector is null or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them all."""
    most = int(np.abs(x).max(initial=0)) if x.min(initial=0) > np.iinfo(np.int64).min else 1 << 62
    return np.ascontiguousarray(x.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(t).max)))


def _wide(blob, dim: int, rows: int) -> np.ndarray:  # noqa: ANN001
    """The array of a blob of :func:`_narrow`; its type follows from its length."""
    width = len(blob) // max(1, dim * rows) or 8
    return np.frombuffer(blob, dtype=f"<i{width}").reshape(rows, dim).astype(np.int64)


_BLOB = "no long, dim int, rows int, longest double, ids binary, x binary"


def _packed(limit: int):
    """Rows of a partition as numbered blobs of at most ``limit`` vectors of one dimension, longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        task, seq = TaskContext.get().partitionId() << 32, itertools.count()

        def blob(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            ids = np.array([i for i, _ in rows], dtype=np.int64)
            x = np.stack([v for _, v in rows]) if dim else np.zeros((len(rows), 0), np.int64)
            norm = np.sqrt((x.astype(float) ** 2).sum(1))
            at = np.lexsort((ids, -norm))
            cols = [pa.array([task + next(seq)], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([float(norm.max())]), pa.array([ids[at].tobytes()], pa.binary()), pa.array([_narrow(x[at]).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["no", "dim", "rows", "longest", "ids", "x"])

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            ends = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            flat = vectors.flatten().to_numpy()
            for r, i in enumerate(ids):
                v = flat[ends[r] : ends[r + 1]]
                rows = held.setdefault(len(v), [])
                rows.append((int(i), v))
                if len(rows) == limit:
                    yield blob(len(v))
        for dim in list(held):
            yield blob(dim)

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where no sum can leave its exact range."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def slack(dim: int) -> float:
    """More than the relative rounding error of a norm, a cosine or a quotient of them in ``dim`` dimensions."""
    return 4 * (dim + 8) * float(np.finfo(float).eps)


def search_bucket(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, id, score): each query's best ``k`` of one bucket (longest first) among scores of at least ``floor``."""
    norm, q_norm = np.sqrt((x.astype(float) ** 2).sum(1)), np.sqrt((q.astype(float) ** 2).sum(1))
    eps = slack(q.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(np.isneginf(floor), -np.inf, floor / (q_norm * norm[0]))
    local = np.where(np.isnan(local), -np.inf, local)
    alive = np.flatnonzero((local <= 1 + eps) | (q_norm * norm[0] == 0))
    steep = alive[(local[alive] >= STEEP) & (q_norm[alive] > 0)]
    out: list[tuple[np.ndarray, ...]] = []

    def keep(row: np.ndarray, cand: np.ndarray, score: np.ndarray) -> None:
        ok = (score >= floor[row]) & (ids[cand] != q_ids[row])
        row, cand, score = row[ok], cand[ok], score[ok]
        at = np.lexsort((ids[cand], -score, row))
        row, cand, score = row[at], cand[at], score[at]
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, int)
        place = np.arange(len(row)) - np.repeat(begin, np.diff([*begin, len(row)]))
        ok = place < k
        out.append((row[ok], ids[cand[ok]], score[ok]))

    if len(steep):
        root = 4 * np.sqrt(eps)  # an angle near 0 is off by the root of its cosine's error
        unit = x / np.maximum(norm, 1e-300)[:, None]
        focus = np.abs(q[steep]).argmax(1)
        for f in np.unique(focus):
            order = np.argsort(unit[:, f], kind="stable")
            line = unit[order, f]
            for r in steep[focus == f]:  # the candidate's coordinate lies within the threshold's angle of the query's
                a, t = np.arccos(np.clip(q[r, f] / q_norm[r], -1, 1)), np.arccos(np.clip(local[r], -1, 1))
                lo, hi = np.cos(min(np.pi, a + t)) - root, np.cos(max(0.0, a - t)) + root
                cand = order[np.searchsorted(line, lo, "left") : np.searchsorted(line, hi, "right")]
                keep(np.full(len(cand), r), cand, _products(q[r : r + 1], x[cand])[0])
    flat = alive[~((local[alive] >= STEEP) & (q_norm[alive] > 0))]
    if len(flat):
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(floor[flat] > 0, floor[flat] / np.maximum(q_norm[flat], 1e-300), -1.0)
        upto = int(np.searchsorted(-norm, -(least.min() * (1 - eps)), side="right"))
        score = _products(q[flat], x[:upto])
        most = k + int(np.unique(ids, return_counts=True)[1].max())
        if upto > most:  # the best of a query's row and as many as its own id may take, and whatever ties with the last
            cut_at = np.partition(score, upto - most, axis=1)[:, upto - most]
            row, cand = np.nonzero(score >= np.maximum(cut_at, np.where(np.isneginf(floor[flat]), np.iinfo(np.int64).min, np.nan_to_num(floor[flat], neginf=0)).astype(np.int64))[:, None])
        else:
            row, cand = np.nonzero(np.ones_like(score, dtype=bool))
        keep(flat[row], cand, score[row, cand])
    if not out:
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _lowered(floor: np.ndarray) -> np.ndarray:
    """Scores as doubles that don't exceed them, where they are beyond the exact range."""
    return np.where(np.abs(floor) >= 2**53, np.nextafter(floor, -np.inf), floor)


def _search(k: int):
    """Rows come by bucket, the bucket's blob first, then the query blocks that may find something there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = x = None
        for batch in batches:
            for r in range(batch.num_rows):
                first, dim, rows = (batch.column(c)[r].as_py() for c in ("first", "dim", "rows"))
                get = lambda c: batch.column(c)[r].as_buffer()
                own, v = np.frombuffer(get("ids"), dtype="<i8"), _wide(get("x"), dim, rows)
                if first:
                    ids, x = own.copy(), v
                    continue
                row, cand, score = search_bucket(own, v, np.frombuffer(get("floors"), dtype="<f8"), ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(cand), pa.array(score)], names=["query_id", "id", "score"])

    return run


def _with_floor(k: int):
    """Query blocks against the longest bucket: their k-th scores become the blocks' floors; ``least``: the length below which no query finds anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, rows, many = (batch.column(c)[r].as_py() for c in ("dim", "rows", "c_rows"))
                get = lambda c: batch.column(c)[r].as_buffer()
                q_ids, ids = (np.frombuffer(get(c), dtype="<i8") for c in ("ids", "c_ids"))
                q, x = _wide(get("x"), dim, rows), _wide(get("c_x"), dim, many)
                floor = np.full(len(q), -np.inf)
                row, _, score = search_bucket(q_ids, q, floor, ids, x, k)
                n = np.bincount(row, minlength=len(q))
                low = np.full(len(q), np.inf)
                np.minimum.at(low, row, score.astype(float))
                floor[n == k] = _lowered(low[n == k])
                norm = np.sqrt((q.astype(float) ** 2).sum(1))
                least = np.where(norm > 0, floor / np.maximum(norm, 1e-300), -np.inf).min()
                cols = [batch.column(c).slice(r, 1) for c in ("no", "dim", "rows", "ids", "x")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([floor.tobytes()], pa.binary()), pa.array([float(least)])], names=["no", "dim", "rows", "ids", "x", "floors", "least"])

    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "x", k: int = 20) -> DataFrame:
    """The ``k`` highest integer inner products of each query with all rows but its own id: (query_id, rank, id, score).

    ``vector_col`` holds arrays of longs; null vectors take no part, vectors of other dimensions than the query's have no
    product with it, and ties go to the smaller id (all, if fewer than ``k``). Rows are dealt by length into buckets of at
    most :data:`BUCKET`, queries into blocks of at most :data:`BLOCK`. The longest bucket of a dimension gives every query
    its first floor. Then pairs of block and bucket are chosen on their lengths and floors alone, before any vector moves: a
    bucket whose longest vector can't reach a block's floors is never met. A bucket travels once for each :data:`SHARE` blocks
    that meet it, a block once to each bucket it meets, and a task holds one of each. There local cosine thresholds decide
    between looking candidates up by the query's largest coordinate and by length; products are verified exactly, and at most
    ``k`` rows a query go on. Rows that repeat an id count as often as listed. Null ids take no part. An empty table gives an
    empty result.
    """
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"), F.coalesce(is_query, F.lit(False)).alias("is_q"))
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    sized = stored(rows.withColumn("norm", norm))
    n, n_q = sized.agg(F.count(F.lit(1)), F.count_if("is_q")).first()
    dealt = sized.repartitionByRange(-(-n // BUCKET) or 1, F.col("norm").desc(), F.col("id")).select("id", "x")
    buckets = stored(dealt.mapInArrow(_packed(BUCKET), _BLOB))
    blocks = sized.where("is_q").repartition(-(-n_q // BLOCK) or 1).select("id", "x").mapInArrow(_packed(BLOCK), _BLOB).drop("longest")
    about = buckets.select("dim", F.col("no").alias("b"), "longest")
    longest = about.groupBy("dim").agg(F.max_by("b", F.struct("longest", F.col("b"))).alias("b")).select("b")
    first = buckets.join(F.broadcast(longest) if longest.limit(FEW + 1).count() <= FEW else longest, F.col("no") == F.col("b")).select("dim", F.col("rows").alias("c_rows"), F.col("ids").alias("c_ids"), F.col("x").alias("c_x"))
    first = F.broadcast(first) if longest.limit(FEW + 1).count() <= FEW else first
    floored = stored(blocks.join(first, "dim").mapInArrow(_with_floor(k), "no long, dim int, rows int, ids binary, x binary, floors binary, least double"))
    pairs = floored.select(F.col("no").alias("q"), "dim", "least").join(if_small(about), "dim").where(f"longest * {1 + slack(1 << 20)!r} >= least")
    pairs = stored(pairs.select("q", "b", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-n_q // (BLOCK * SHARE))))).alias("salt")))
    blob = lambda first, floors: [F.lit(first).alias("first"), "dim", "rows", "ids", "x", floors.alias("floors")]
    place = pairs.select("b", "salt").distinct()
    left = place.join(buckets.withColumnRenamed("no", "b"), "b").select("b", "salt", *blob(True, F.lit(None).cast("binary")))
    right = pairs.join(floored.withColumnRenamed("no", "q"), "q").select("b", "salt", *blob(False, F.col("floors")))
    met = left.union(right).repartition(max(1, place.count()), "b", "salt").sortWithinPartitions("b", "salt", F.desc("first"))
    found = met.select("first", "dim", "rows", "ids", "x", "floors").mapInArrow(_search(k), "query_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
