"""Scores of text pairs that outlive a run: each pair is scored once, block by block, and a restart goes on after the last commit."""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.sources import io

#: Pairs that are scored and committed together, about.
BLOCK_ROWS = 1_000_000
KEY = "pair_key"


def pair_key(*texts: Column) -> Column:
    """What names a pair: the SHA-256 of its texts, each behind its length; null differs from empty."""
    parts = [F.concat_ws(":", F.coalesce(F.length(t).cast("string"), F.lit("null")), F.coalesce(t, F.lit(""))) for t in texts]
    return F.sha2(F.concat(*parts), 256)


class Memo:
    """A folder of scored blocks under one name. A block counts once its commit file is there, which appears in one rename.

    So a reader never sees half a block, a killed run loses only the block at hand, and several runs may share the folder: at
    worst they score a pair twice, which readers don't notice.
    """

    def __init__(self, spark: SparkSession, path: str, name: str) -> None:
        self.spark, self.at = spark, f"{path.rstrip('/')}/{name}"

    def blocks(self) -> list[str]:
        """Paths of the committed blocks."""
        return [f"{self.at}/data/{json.loads(text)['block']}" for text in io.read_texts(self.spark, f"{self.at}/commits").values()]

    def table(self) -> DataFrame | None:
        """All committed scores, one row a pair; None where there are none yet."""
        paths = self.blocks()
        return self.spark.read.parquet(*paths).dropDuplicates([KEY]) if paths else None

    def commit(self, scores: DataFrame) -> None:
        block = uuid.uuid4().hex
        scores.write.parquet(f"{self.at}/data/{block}")
        io.create_text(self.spark, json.dumps({"block": block, "columns": scores.columns}), f"{self.at}/commits/{block}.json")

    def missing(self, pairs: DataFrame) -> DataFrame:
        """Pairs without a committed score."""
        known = self.table()
        return pairs if known is None else pairs.join(known.select(KEY), KEY, "left_anti")

    def fill(self, pairs: DataFrame, score: Callable[[DataFrame], DataFrame], columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> int:
        """Score what is missing, some ``block_rows`` pairs to a commit; returns how many pairs that were."""
        todo = self.missing(pairs)
        n = todo.count()
        blocks = -(-n // block_rows)
        for k in range(blocks):
            some = todo.where(F.pmod(F.xxhash64(KEY), F.lit(blocks)) == k)
            self.commit(score(some).select(KEY, *columns))
        return n


def scored(
    df: DataFrame, texts: Sequence[str], signals: dict[str, tuple[Callable[[DataFrame], DataFrame], Sequence[str]]], path: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``df`` with the columns of every signal, each distinct pair of ``texts`` scored once and kept in the folder ``path``.

    ``signals``: by name, a function that adds its columns to a frame of the texts, and those columns. Signals are separate
    memos, so one that is added later, or whose run was stopped, is filled without touching the others.
    """
    keyed = df.withColumn(KEY, pair_key(*[F.col(t) for t in texts]))
    pairs = keyed.select(KEY, *texts).dropDuplicates([KEY])
    out = keyed
    for name, (score, columns) in signals.items():
        memo = Memo(df.sparkSession, path, name)
        memo.fill(pairs, score, columns, block_rows)
        known = memo.table()
        if known is None:  # nothing to score
            known = score(pairs.limit(0)).select(KEY, *columns)
        out = out.join(known.select(KEY, *columns), KEY, "left")
    return out.drop(KEY)
