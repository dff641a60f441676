"""Seeded character corruption over a confusion matrix, exposure tables, matrix diagnostics."""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from emberlane.functions import text as tx
from emberlane.operators import ordered as od
from emberlane.scratch import Scratch

ALPHABET = tx.GRID
#: Share of the error budget for insertions and deletions together (fixed value).
INDEL_SHARE = 0.1
#: Texts that a task draws noise for, about.
DRAWN_ROWS = 20_000
_META = T.StructType([
    T.StructField("noisy_text", T.StringType()), T.StructField("sub_count", T.IntegerType()), T.StructField("ins_count", T.IntegerType()), T.StructField("del_count", T.IntegerType()),
    T.StructField("error_positions", T.ArrayType(T.IntegerType())), T.StructField("n_passthrough_chars", T.IntegerType()),
])


class Channel:
    """Draws per character: indel, substitution from the character's confusion row, or copy; one seeded stream per text.

    Which draw follows which is a fixed value: with it a seed gives the same corrupted text as in earlier exposure tables.
    """

    def __init__(self, matrix: np.ndarray, alphabet: str = ALPHABET) -> None:
        self.alphabet, self.place = alphabet, {c: i for i, c in enumerate(alphabet)}
        off = np.array(matrix, dtype=float)
        np.fill_diagonal(off, 0.0)
        total = off.sum(axis=1)
        self.rows = [np.cumsum(row / s) if s > 0 else None for row, s in zip(off, total, strict=True)]
        self.rows = [None if r is None else (r / r[-1]).tolist() for r in self.rows]
        self.others = [[j for j in range(len(alphabet)) if j != i] for i in range(len(alphabet))]

    def corrupt(self, text: str, rate: float, seed: int) -> tuple[str, int, int, int, list[int], int]:
        if rate <= 0:
            return text, 0, 0, 0, [], sum(c not in self.place for c in text)
        rng = np.random.default_rng(seed)
        indel, both = rate * INDEL_SHARE, rate * INDEL_SHARE + rate * (1 - INDEL_SHARE)
        made: list[str] = []
        hit: list[int] = []
        tally = {"sub": 0, "ins": 0, "del": 0, "pass": 0}
        for at, c in enumerate(text):
            u, own = rng.random(), self.place.get(c)
            if u < indel:
                kind = "del" if rng.random() < 0.5 else "ins"
                if kind == "ins":
                    made += [self.alphabet[rng.integers(len(self.alphabet))], c]
            elif own is not None and u < both:
                kind, row = "sub", self.rows[own]
                to = self.others[own][rng.integers(len(self.others[own]))] if row is None else bisect_right(row, rng.random())
                made.append(self.alphabet[to])
            else:
                made.append(c)
                tally["pass"] += own is None
                continue
            tally[kind] += 1
            hit.append(at)
        return "".join(made), tally["sub"], tally["ins"], tally["del"], hit, tally["pass"]


def matrix_long(pairs: DataFrame, alphabet: str = ALPHABET) -> DataFrame:
    """(intended, selected, n, p): counts of alphabet pairs, row-normalised; rows never seen are absent (zeros)."""
    inside = F.lit(alphabet).contains(F.col("intended")) & F.lit(alphabet).contains(F.col("selected")) & (F.length("intended") == 1) & (F.length("selected") == 1)
    n = pairs.where(inside).groupBy("intended", "selected").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("intended")))


def matrix_array(long: DataFrame, alphabet: str = ALPHABET) -> np.ndarray:
    """The dense matrix: at most the square of the alphabet's rows are collected."""
    m = np.zeros((len(alphabet), len(alphabet)))
    for r in long.select("intended", "selected", "p").collect():
        m[alphabet.index(r[0]), alphabet.index(r[1])] = r[2]
    return m


def top_confusions(long: DataFrame, k: int = 10) -> DataFrame:
    return long.where("intended != selected").orderBy(F.desc("n"), "intended", "selected").limit(k).select("intended", "selected", "n", F.col("p").alias("conditional_rate"))


def overall_error(pairs: DataFrame, alphabet: str = ALPHABET) -> DataFrame:
    inside = F.lit(alphabet).contains(F.col("intended")) & F.lit(alphabet).contains(F.col("selected"))
    return pairs.where(inside).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("intended") != F.col("selected")).cast("double")).alias("error_rate"))


def row_column_mass(long: DataFrame, alphabet: str = ALPHABET, side: int = 6) -> DataFrame:
    """Off-diagonal mass in the same row, the same column, or neither, of the grid, against uniform expectation."""
    i, j = F.instr(F.lit(alphabet), F.col("intended")) - 1, F.instr(F.lit(alphabet), F.col("selected")) - 1
    same_row, same_col = F.floor(i / side) == F.floor(j / side), i % side == j % side
    off = long.where("intended != selected")
    total = F.sum("n").cast("double")
    part = lambda c: (F.sum(F.when(c, F.col("n")).otherwise(0)) / total).cast("double")
    cells = side * side - 1
    return off.agg(part(same_row).alias("row_mass"), part(same_col).alias("column_mass"), part(~same_row & ~same_col).alias("neither_mass"), F.lit((side - 1) / cells).alias("expected_row"), F.lit((side - 1) / cells).alias("expected_column"), F.lit((side - 1) ** 2 / cells).alias("expected_neither"))


def off_grid_summary(df: DataFrame, text: str = "text") -> DataFrame:
    """Mean and exact median of the texts' off-grid shares; texts are read once, later passes see a number a text."""
    shares = Scratch(df.sparkSession).keep(df.select(tx.off_grid_fraction(F.col(text)).alias("f")))
    (median,) = od.quantiles(shares, F.col("f"), [0.5])
    return shares.agg(F.avg("f").alias("mean"), F.lit(median).cast("double").alias("median"), F.count(F.lit(1)).alias("n"))


def corrupted(df: DataFrame, matrix: np.ndarray, rate: str = "cer_target", seed: str = "seed", text: str = "text") -> DataFrame:
    """``df`` with noisy_text and its counts, drawn by an Arrow-batched function; the matrix travels by broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(Channel(matrix))

    @F.pandas_udf(_META)
    def noise(t, r, s):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([shared.value.corrupt(a, float(b), int(c)) for a, b, c in zip(t, r, s, strict=True)], columns=_META.fieldNames())

    return df.withColumn("_n", noise(text, rate, seed)).select("*", "_n.*").drop("_n")


def exposure(messages: DataFrame, matrix: np.ndarray, rates: Sequence[float] = (0.0, 0.1, 0.2, 0.3, 0.4), replicates: int = 3, master_seed: int = 0) -> DataFrame:
    """Message x rate x replicate with seeded noise, realised rate and what was touched.

    Messages are dealt first and multiplied where they then lie, so a task sends each of its messages once.
    """
    parts = messages.count() * len(rates) * replicates // DRAWN_ROWS + messages.sparkSession.sparkContext.defaultParallelism
    t = messages.select("message_id", "corpus", F.upper("text").alias("text")).repartition(parts, "message_id")
    grid = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("cer_target"), F.lit(str(float(r))).alias("_r")) for r in rates])).alias("_g")
    t = t.select("message_id", "corpus", "text", grid).select("message_id", "corpus", "text", "_g.*")
    t = t.withColumn("replicate_idx", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    t = t.withColumn("seed", tx.stable_seed(F.col("message_id"), F.col("_r"), F.col("replicate_idx").cast("string"), F.lit(str(master_seed))))
    out = corrupted(t.drop("_r"), matrix)
    flags = tx.corruption_flags("text", "error_positions")
    out = out.withColumn("realized_cer", tx.cer(F.col("text"), F.col("noisy_text"))).withColumn("n_errors", F.col("sub_count") + F.col("ins_count") + F.col("del_count"))
    return out.withColumn("_f", flags).select("*", "_f.*").drop("_f")


def exposure_by_subject(messages: DataFrame, matrices: dict[str, np.ndarray], rates: Sequence[float], master_seed: int = 0) -> DataFrame:
    """First layout: message x subject x rate, each subject with its own matrix."""
    out = None
    for subject, m in sorted(matrices.items()):
        t = exposure(messages, m, rates, 1, master_seed).withColumn("source_subject", F.lit(subject)).drop("replicate_idx")
        out = t if out is None else out.unionByName(t)
    return out


def held_out_sensitivity(messages: DataFrame, matrices: dict[str, np.ndarray], rates: Sequence[float]) -> DataFrame:
    """Mean realised rate per subject and level against the pooled matrix: range, mean, deviation, largest differences."""
    pooled = sum(matrices.values()) / max(1, len(matrices))
    base = exposure(messages, pooled, rates, 1).groupBy("cer_target").agg(F.avg("realized_cer").alias("pooled"))
    per = exposure_by_subject(messages, matrices, rates).groupBy("source_subject", "cer_target").agg(F.avg("realized_cer").alias("m"))
    gap = F.abs(F.col("m") - F.col("pooled"))
    return per.join(F.broadcast(base), "cer_target").groupBy("cer_target", "pooled").agg(F.min("m").alias("min"), F.max("m").alias("max"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.max(gap).alias("max_abs_diff"), F.max(F.try_divide(gap, F.col("pooled"))).alias("max_rel_diff"))


def allocation(rate: float) -> dict[str, float]:
    """Configured budget of a rate: substitutions, insertions, deletions per character."""
    return {"substitution": rate * (1 - INDEL_SHARE), "insertion": rate * INDEL_SHARE / 2, "deletion": rate * INDEL_SHARE / 2}
