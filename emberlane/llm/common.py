"""Shared helpers: the shared folder, lineage cuts, bounded bit filters, connected components."""
from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a few longs (about 16 to 32 bytes each) that are broadcast at most; more are joined by shuffles.
BROADCAST_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder set by the caller.

    Raises where neither is set, but in local mode, where all share the warehouse's machine: there it lies in the warehouse.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return conf or set_dir.get()
    if not conf:
        if not re.fullmatch(r"local(\[[\d*,]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/emberlane-shared"
    spark.sparkContext.setCheckpointDir(conf)
    return conf


def bounded_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Arrow batches of at most ``limit`` bytes in this session, whatever the length of a row's text, where more was allowed."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "67108864b").rstrip("b")) > limit:
        spark.conf.set(key, str(limit))


_scopes: list[str] = []
_live: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    _live.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, columnar and prunable.

    The table goes with :func:`drop_stored`, at the end of the :func:`scratch` that it was made in, or else when the driver
    ends: until then a result that is still to be read may need it.
    """
    spark = df.sparkSession
    path = "/".join([shared_dir(spark).rstrip("/"), *_scopes[-1:], f"table-{uuid.uuid4().hex}"])
    schema = df.schema
    df.write.parquet(path)
    _live[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` once nothing that is still to run reads them."""
    for t in tables:
        _delete(t.sparkSession, t._stored_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within are deleted at the end, but those stored by the function that it gives."""
    name = f"scratch-{uuid.uuid4().hex}"
    _scopes.append(name)

    def keep(df: DataFrame) -> DataFrame:
        inner = _scopes.pop()
        try:
            return stored(df)
        finally:
            _scopes.append(inner)

    try:
        yield keep
    finally:
        _scopes.remove(name)
        at = f"{shared_dir(spark).rstrip('/')}/{name}"
        for path in [p for p in _live if p.startswith(f"{at}/")]:
            _live.pop(path)
        _delete(spark, at)


@atexit.register
def _clean_up() -> None:
    for path, spark in list(_live.items()):
        if spark.sparkContext._jsc is not None:  # else the session is gone, and its folder is the cluster's to clean
            _delete(spark, path)


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def _unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``frames`` is called so (names count in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bit_flag(df: DataFrame, key: Column, ids: DataFrame, id_col: str, flag: str, bits: int = 1 << 26) -> DataFrame:
    """``df`` with a boolean ``flag``: false only where the key surely doesn't occur in ``ids``.

    ``ids`` is folded into at most ``bits / 32768`` bitmaps of 4 KiB; that is the bound of the broadcast
    (8 MiB at the default), whatever the size of ``ids``. An exact step has to follow. ``df`` may have columns of any name
    but ``flag``.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    p, b, m = (_unused(c, df) for c in ("_p", "_b", "_map"))
    maps = (
        ids.select(_bit(F.col(id_col), bits).alias(p))
        .groupBy(F.expr(f"{p} div 32768").alias(b))
        .agg(F.bitmap_construct_agg(F.expr(f"{p} % 32768")).alias(m))
    )
    marked = df.select(*cols, _bit(key, bits).alias(p)).withColumn(b, F.expr(f"{p} div 32768"))
    hit = F.expr(
        f"coalesce((cast(conv(hex(substring({m}, cast(({p} % 32768) div 8 + 1 as int), 1)), 16, 10) as int)"
        f" & shiftleft(1, cast({p} % 8 as int))) != 0, false)"
    )
    return marked.join(F.broadcast(maps), b, "left").select(*cols, hit.alias(flag))


def bit_filter(df: DataFrame, key: Column, ids: DataFrame, id_col: str, bits: int = 1 << 26) -> DataFrame:
    """Rows of ``df`` whose key may occur in ``ids``: no row that does is lost, a few others stay."""
    flag = _unused("_may", df)
    return bit_flag(df, key, ids, id_col, flag, bits).where(flag).drop(flag)


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str, ways: int = 64) -> DataFrame:
    """``left.join(right, key, how)`` with the rows of hot keys dealt to ``ways`` tasks, whatever follows the join.

    ``hot`` lists keys (in a column named ``key``) with many rows in ``left``; each has few in ``right``. Both sides look
    them up in one bitmap, so they agree on what counts as hot, also where a key shares a bit with a hot one.
    """
    own = [F.col(f"`{c}`") for c in left.columns]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*own), F.lit(ways))).otherwise(0).cast("int")
    x = bit_flag(left, F.col(key), hot, key, "_hot").select(*own, salt.alias("_salt"))
    ways_of = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    y = bit_flag(right, F.col(key), hot, key, "_hot").select(*[F.col(f"`{c}`") for c in right.columns], F.explode(ways_of).alias("_salt"))
    return x.join(y, [key, "_salt"], how).drop("_salt")


def row_keys(id_col: Column, text: Column) -> list[Column]:
    """Two hashes (k1 long, k2 int) of a row's id and text; rows that agree in both are treated as one row listed twice."""
    return [F.xxhash64(text, id_col).alias("k1"), F.hash(id_col, text).alias("k2")]


def wrapped(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row as one struct ``_row`` beside named columns, so names in ``docs`` can't clash with those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(k) for k, c in more.items()])


def unwrapped(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def without(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, once: DataFrame) -> DataFrame:
    """``docs`` less the rows whose keys (k1, k2) are listed, and one row for each of the keys ``once``.

    Only rows that a bit filter suspects are shuffled; of rows listed several times the copies go in the partial aggregation.
    """
    k1, k2 = row_keys(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    flagged = bit_flag(wrapped(docs, k1=k1, k2=k2), F.col("k1"), keys.select("k1").unionByName(once.select("k1")), "k1", "_may")
    rest = flagged.where("_may").join(keys, ["k1", "k2"], "left_anti")
    rest = rest.groupBy("k1", "k2").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return unwrapped(flagged.where("not _may").select("_row").unionByName(rest.select("_row")), docs)


def if_small(rows: DataFrame) -> DataFrame:
    """Broadcast behind a check of the size: at most :data:`BROADCAST_ROWS` rows of a few longs; a larger table is joined as it is."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def few(rows: int) -> int:
    """Partitions for a table of so many narrow rows: small tables in few files, large ones spread as they grow."""
    return rows // 200_000 + 1


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: each node with the smallest it reaches within the partition."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts), return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:  # nodes are sorted, so the smallest place is the smallest node
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[label[away]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u long, v long): rows (node, component), component the smallest node.

    Links go by :func:`few` to a partition and become stars there; while there are several partitions, large-star /
    small-star rounds follow: each takes every node's smallest neighbour by a partial aggregation and joins it back, so a
    node with very many links is never gathered; about log(n) rounds, each written out. Nodes without links to others do not
    appear.
    """
    star = "u long, v long"
    links = stored(edges.where("u != v").select("u", "v"))
    parts = few(links.count())
    e = stored(links.coalesce(parts).mapInArrow(_contracted, star))
    drop_stored(links)
    before = None
    while parts > 1:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        old, e = e, stored(small.coalesce(parts).mapInArrow(_contracted, star).distinct())
        drop_stored(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
