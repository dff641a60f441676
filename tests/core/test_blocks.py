"""Shared runs against the definition, and a noise channel that draws as numpy's own weighted choice does."""
import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.functions import blocks
from emberlane.functions import text as tx
from emberlane.operators import noise


def by_definition(a, b):
    flags = [True] * len(b)
    for _, at, n in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks():
        flags[at : at + n] = [False] * n
    return flags


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefghijklmnop"])
def test_runs_equal_the_definition(letters):
    rng = random.Random(letters)
    for _ in range(250):
        a = rng.choices(letters, k=rng.randint(0, 60))
        b = list(a) if rng.random() < 0.5 else rng.choices(letters, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 6)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(letters)
        assert blocks.changed(*blocks.coded(a, b)).tolist() == by_definition(a, b)


def test_long_and_repetitive_sequences():
    rng = random.Random(3)
    a = rng.choices("abcdefgh ", k=4000)
    b = a[:1500] + rng.choices("xyz", k=30) + a[1600:]
    assert blocks.changed(*blocks.coded(a, b)).tolist() == by_definition(a, b)
    assert not blocks.changed(*blocks.coded(["a"] * 5000, ["a"] * 4000)).any()
    assert blocks.changed(*blocks.coded([], ["a"])).tolist() == [True] and blocks.changed(*blocks.coded(["a"], [])).tolist() == []


def test_listed_runs_equal_numbered_runs(monkeypatch):
    rng = random.Random(5)
    pairs = [blocks.coded(rng.choices(letters, k=rng.randint(1, 150)), rng.choices(letters, k=rng.randint(1, 400))) for letters in ("ab", "abcdefgh ") for _ in range(60)]
    assert all(p[0].size * p[1].size < blocks.TABLE for p in pairs)
    with monkeypatch.context() as m:
        m.setattr(blocks, "Runs", None)  # texts as short as these don't need it
        listed = [blocks.changed(*p).tolist() for p in pairs]
    monkeypatch.setattr(blocks, "TABLE", 0)
    assert listed == [blocks.changed(*p).tolist() for p in pairs]


def test_flags_as_columns(spark):
    rows = [("Send the water now", "Send the cold water now"), (None, "a b"), ("a b", None), ("", ""), ("naïve ê", "naive ê")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(tx.changed_words("a", "b").alias("w"), tx.changed_characters("a", "b").alias("c")).collect()
    for r, (a, b) in zip(got, rows, strict=True):
        assert r["w"] == by_definition((a or "").split(), (b or "").split()) and r["c"] == by_definition(list(a or ""), list(b or ""))


def test_channel_draws_as_weighted_choice():
    rng = np.random.default_rng(2)
    matrix = rng.random((36, 36)) ** 4
    np.fill_diagonal(matrix, 3)
    channel = noise.Channel(matrix)
    for k, row in enumerate(channel.rows):
        p = matrix[k].copy()
        p[k] = 0
        a, b = np.random.default_rng(k), np.random.default_rng(k)
        assert [int(a.choice(36, p=p / p.sum())) for _ in range(50)] == [noise.bisect_right(row, b.random()) for _ in range(50)]


def test_exposures_do_not_depend_on_partitions(spark):
    words = spark.createDataFrame([(f"m{i}", "AUTH", f"send {i} units of water") for i in range(40)], "message_id string, corpus string, text string")
    matrix = np.ones((36, 36))
    one, two = (sorted(map(str, noise.exposure(t, matrix).collect())) for t in (words, words.repartition(7).orderBy(F.desc("text"))))
    assert one == two and len(one) == 600
