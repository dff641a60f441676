"""Scores that outlive a killed run, sinks that show nothing half done, and a log that concurrent writers share."""
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberlane.sources import io, memo

TEXTS = ["a", "b"]


def counting(spark, stop_at=None):
    """A scorer that counts the pairs it scores, and the frames it was asked for; it fails at the ``stop_at``-th."""
    seen, calls = spark.sparkContext.accumulator(0), []

    def score(df):
        calls.append(1)
        if len(calls) == stop_at:
            raise InterruptedError

        def run(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf.assign(same=pdf["a"].fillna("") == pdf["b"].fillna(""))

        return df.mapInPandas(run, "pair_key string, a string, b string, same boolean")

    return score, seen, calls


def pairs(spark, n=120):
    rows = [(i, f"t{i % 40}", f"t{i % 30}") for i in range(n)] + [(n, None, ""), (n + 1, "", None), (n + 2, "", "")]
    return spark.createDataFrame(rows, "id long, a string, b string").repartition(3)


def test_a_stopped_run_goes_on_without_scoring_twice(spark, tmp_path):
    df = pairs(spark)
    distinct = len({(r["a"], r["b"]) for r in df.collect()})
    first, seen_first, calls = counting(spark, stop_at=4)
    with pytest.raises(InterruptedError):
        memo.scored(df, TEXTS, {"same": (first, ["same"])}, str(tmp_path), block_rows=20)
    kept = memo.Memo(spark, str(tmp_path), "same").table().count()
    assert len(calls) == 4 and 0 < kept == seen_first.value < distinct
    second, seen_second, _ = counting(spark)
    out = memo.scored(df, TEXTS, {"same": (second, ["same"])}, str(tmp_path), block_rows=20).collect()
    assert seen_second.value == distinct - kept
    assert len(out) == df.count() and all(r["same"] == ((r["a"] or "") == (r["b"] or "")) for r in out)
    third, seen_third, calls = counting(spark)
    memo.scored(df, TEXTS, {"same": (third, ["same"])}, str(tmp_path)).count()
    assert seen_third.value == 0 and not calls
    more = df.unionByName(spark.createDataFrame([(500, "new", "pair")], df.schema))
    fourth, seen_fourth, _ = counting(spark)
    assert memo.scored(more, TEXTS, {"same": (fourth, ["same"])}, str(tmp_path)).count() == df.count() + 1 and seen_fourth.value == 1


def test_blocks_without_a_commit_do_not_count_and_doubles_do_not_show(spark, tmp_path):
    df = pairs(spark, 20)
    score, *_ = counting(spark)
    keyed = df.withColumn(memo.KEY, memo.pair_key(F.col("a"), F.col("b"))).select(memo.KEY, "a", "b").dropDuplicates([memo.KEY])
    one, two = (memo.Memo(spark, str(tmp_path), "same") for _ in range(2))
    (Path(tmp_path) / "same/data/orphan").mkdir(parents=True)
    todo = two.missing(keyed)
    one.fill(keyed, score, ["same"])
    two.commit(score(todo).select(memo.KEY, "same"))
    assert len(one.blocks()) == 2 and one.table().count() == keyed.count() and one.missing(keyed).count() == 0
    assert memo.scored(df.limit(0), TEXTS, {"none": (score, ["same"])}, str(tmp_path)).columns == ["id", "a", "b", "same"]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/table"
    io.write_parquet(spark.range(3), path)
    bad = spark.range(9).withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="no"):
        io.write_parquet(bad, path)
    assert spark.read.parquet(path).count() == 3 and sorted(p.name for p in Path(tmp_path).iterdir() if not p.name.startswith(".")) == ["table"]
    io.write_parquet(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    io.write_text(spark, "one", f"{tmp_path}/t.txt")
    io.write_text(spark, "two", f"{tmp_path}/t.txt")
    assert io.read_text(spark, f"{tmp_path}/t.txt") == "two"


def test_writers_at_the_same_time_lose_no_entry(spark, tmp_path):
    log = f"{tmp_path}/log"
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: io.log_provenance(spark, log, f"n{k % 3}", {f"k{k}": k}), range(30)))
    got = io.read_provenance(spark, log)
    assert {k for v in got.values() for k in v} == {f"k{k}" for k in range(30)} and set(got) == {"n0", "n1", "n2"}
    io.create_text(spark, "x", f"{tmp_path}/once.json")
    with pytest.raises(FileExistsError):
        io.create_text(spark, "y", f"{tmp_path}/once.json")
    assert {"versions", "application", "master", "at"} <= set(io.run_facts(spark))


def test_large_sheets_are_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "SHEET_ROWS", 50)
    for n in (50, 51):
        df = spark.range(n).selectExpr("cast(id as string) id", "'a \"b\", c' t").repartition(4)
        io.write_csv(df, f"{tmp_path}/s{n}")
        assert sorted(io.read_csv(spark, f"{tmp_path}/s{n}", ["id"], df.schema).collect()) == sorted(df.collect())
        assert (len(list(Path(f"{tmp_path}/s{n}").glob("part-*"))) > 1) == (n > 50)
