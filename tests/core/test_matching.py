"""Greedy matching in rounds of proposals against the sequential definition, row by row."""
import hashlib
import math
import random

import numpy as np
import pytest

from emberlane.operators import matching


def sequential(critical, pool, seed):
    """Each critical row in order takes its nearest free control; ties by the hash of seed and id."""
    both = np.array([r[1:] for r in critical + pool], dtype=float)
    sd = both.std(0)
    z = (both - both.mean(0)) / np.where(sd == 0, 1, sd)
    a, b = z[: len(critical)], z[len(critical) :]
    ties = [hashlib.sha256(f"{seed}|{r[0]}".encode()).hexdigest() for r in pool]
    free, out = set(range(len(pool))), {}
    for i in sorted(range(len(critical)), key=lambda i: critical[i][0]):
        d = np.round(((b - a[i]) ** 2).sum(1), 9)
        j = min(free, key=lambda j: (d[j], ties[j]))
        free.remove(j)
        out[critical[i][0]] = (pool[j][0], math.sqrt(d[j]))
    return out


def sides(kind, seed, n=150, m=500):
    rng = random.Random(seed)
    if kind == "ties":
        point = lambda: (float(rng.randint(1, 3)), float(rng.randint(0, 1)), 4.0)
    elif kind == "one point":
        point = lambda: (2.0, 1.0, 4.0)
    elif kind == "scarce":
        m = n + 3
        point = lambda: (rng.gauss(0, 1), float(rng.randint(0, 1)), rng.random())
    else:
        point = lambda: (rng.gauss(0, 1), float(rng.randint(0, 5)), rng.random() ** 3)
    return [(f"c{i:04}", *point()) for i in range(n)], [(f"p{i:04}", *point()) for i in range(m)]


SCHEMA = "message_id string, x double, y double, w double"


@pytest.mark.parametrize("kind", ["plain", "ties", "one point", "scarce"])
@pytest.mark.parametrize("small", [False, True])
def test_equals_the_sequential_definition(spark, monkeypatch, kind, small):
    if small:  # many ranges and blocks, short lists of candidates
        monkeypatch.setattr(matching, "BLOCK", 40)
        monkeypatch.setattr(matching, "RANGE", 60)
        monkeypatch.setattr(matching, "SPARE", 2)
    critical, pool = sides(kind, 3)
    a, b = (spark.createDataFrame(t, SCHEMA).repartition(3) for t in (critical, pool))
    got = matching.greedy_controls(a, b, ["x", "y", "w"], 11, ["message_id"]).collect()
    want = sequential(critical, pool, 11)
    assert {r["crit_message_id"]: r["message_id"] for r in got} == {k: v[0] for k, v in want.items()}
    features = {r[0]: r[1:] for r in critical + pool}
    for r in got:
        assert r["match_distance"] == pytest.approx(want[r["crit_message_id"]][1], abs=1e-9)
        assert (r["x"], r["y"], r["w"]) == features[r["message_id"]] and (r["crit_x"], r["crit_y"], r["crit_w"]) == features[r["crit_message_id"]]


def test_what_cannot_be_matched_raises(spark):
    critical, pool = sides("plain", 5, n=4, m=3)
    a, b = (spark.createDataFrame(t, SCHEMA) for t in (critical, pool))
    with pytest.raises(ValueError, match="candidates"):
        matching.greedy_controls(a, b, ["x"], 1, ["message_id"])
    with pytest.raises(ValueError, match="nulls"):
        matching.greedy_controls(b.limit(1), a.selectExpr("message_id", "cast(null as double) x"), ["x"], 1, ["message_id"])
    assert matching.greedy_controls(a.limit(0), b, ["x", "y"], 1, ["message_id"]).collect() == []


def test_rows_at_one_point_settle_in_one_round(spark, monkeypatch):
    """Blocks of one point start after one another's candidates, so their number doesn't add rounds."""
    monkeypatch.setattr(matching, "BLOCK", 10)
    rounds, real = [], matching._round
    monkeypatch.setattr(matching, "_round", lambda *a: rounds.append(1) or real(*a))
    critical, pool = sides("one point", 3, n=60, m=120)
    a, b = (spark.createDataFrame(t, SCHEMA) for t in (critical, pool))
    got = matching.greedy_controls(a, b, ["x", "y", "w"], 11, ["message_id"]).collect()
    assert {r["crit_message_id"]: r["message_id"] for r in got} == {k: v[0] for k, v in sequential(critical, pool, 11).items()}
    assert len(rounds) == 1
