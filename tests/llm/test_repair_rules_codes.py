"""Conversation repair, quality rules and vector codes against brute force, on awkward and on skewed tables."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.llm import conversation, quality_rules, queries, vector_codes

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\x20\x09-\x0d]+")
TALK = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, source string"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Every way to edit (turn, role, text) rows, cheapest first, then by audit: (cost, audit, repaired lines)."""
    faults = faults_of(rows)
    best = [(3 * len(rows), "D" * len(rows), [])]

    def go(i, cost, audit, out):
        if cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            best[0] = min(best[0], (cost, audit, out), key=lambda b: b[:2])
        for role in ("user", "assistant"):
            go(i, cost + 2, audit + "I", [*out, (role, "")])
        if i == len(rows):
            return
        _, role, text = rows[i]
        go(i + 1, cost + 3, audit + "D", out)
        if faults[i] not in ("blank", "duplicate"):
            stays = int(faults[i] == "truncated")
            go(i + 1, cost + stays, audit + "K", [*out, (role, text)])
            for other in ("user", "assistant"):
                go(i + 1, cost + 2 + stays, audit + "R", [*out, (other, text)])

    go(0, 0, "", [])
    return best[0]


def brute_record(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    cost, audit, out = brute_repair(rows)
    turns = [t for t, *_ in rows if t is not None]
    faults = Counter(faults_of(rows))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out[conv]
        if h:
            mine += [(turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (2 if h == 3 else 1)
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


def talk(seed, n, longest=4):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Really?", "cut off", "cut off ", "", " \t\x0b", "é.", "naïvé", "two\nlines.", None, "A. b"]
    roles = ["user", "assistant", "system", "supervisor", "tool", "User", "", None]
    rows = []
    for c in range(n):
        rows += [(c, rng.choice([None, 0, 1, 2, 5, t]), rng.choices(roles, [5, 5, 3, 1, 1, 1, 1, 1])[0], rng.choice(texts)) for t in range(rng.randint(1, longest))]
    return rows


def test_repair_against_all_edits(spark, monkeypatch):
    monkeypatch.setattr(conversation, "PARTITION_ROWS", 100)
    rows = [*talk(1, 120), (None, 1, "user", "Who?"), (None, 0, "system", "Be kind."), (None, 2, "assistant", "Me.")]
    clash = ["no", "i", "gone", "codes", "conv", "batch", "cost", "copy", "fault"]
    df = spark.createDataFrame(rows, TALK).select("*", *[F.lit(True).alias(c) for c in clash])
    out = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in conversation.repair(df).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert out == {c: brute_record(v) for c, v in want.items()}


def test_registered_repair_damages_first(spark, tmp_path):
    rows = [*talk(2, 150, 3), (7_000, 3, "user", "Only row, dropped."), (None, None, None, None)]
    dropped = next(k for k in range(1000, 4000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    spark.createDataFrame(rows, TALK).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    want = brute_damage(rows)
    assert set(got) == set(want) and want[dropped] == []
    for conv, left in want.items():
        record = brute_record(left)
        assert tuple(got[conv][f] for f in FIELDS[:-1]) == record[:-1], conv
        assert got[conv]["repaired_sha256"] == hashlib.sha256(record[-1].encode()).hexdigest()


def test_repair_streams_batches_and_long_conversations(spark, monkeypatch):
    rows = [(5, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]
    rows += [(c, t, ("system", "user", "assistant")[t], f"{c}.") for c in range(400) for t in range(3) if c != 5]
    monkeypatch.setattr(conversation, "BATCH_ROWS", 50)
    df = spark.createDataFrame(rows, TALK)
    out = {r["conv_id"]: r for r in conversation.repair(df).collect()}
    assert len(out) == 400 and out[5]["cost"] == 0 and out[5]["audit"] == "K" * 3000
    assert all(r["audit"] == "KKK" and r["cost"] == 0 for c, r in out.items() if c != 5)
    table = conversation.pa.table({"conv": conversation.pa.array([3, 3, None, None, 4])})
    assert conversation._numbered(table)[1].tolist() == [0, 2, 4]
    assert conversation.repair(df.limit(0)).collect() == [] and conversation.damaged(df.limit(0)).collect() == []


def plain_rules(rows, docs=20, percent=1, left=50):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    lines = lambda t: [" ".join(WORD.findall(lower(x))) for x in t.split("\n")]
    hosts, holders = defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        hosts[source].add(text or "")
        for line in lines(text or ""):
            holders[source, line].add(text or "")
    out = []
    for i, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
        raw = [x for x in text.split("\n") if WORD.search(x)]
        over = lambda line: len(holders[source, line]) > docs and 100 * len(holders[source, line]) > percent * len(hosts[source])  # noqa: B023, E731
        lost = sum(len(x.split(" ")) for x in lines(text) if x and over(x))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        kept = not failed and 100 * (len(words) - lost) >= left * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(raw) - len(set(raw)), len(covered), failed, kept, lost))
    return out


def rule_docs(seed=4, n=900):
    rng = random.Random(seed)
    say = lambda k: " ".join("".join(rng.choices("abcdeéß#|", k=rng.randint(1, 6))) for _ in range(k))
    menu = [say(15) for _ in range(12)]
    footer, texts = say(12), [None, "", " \n\t", "a", "x\nx\n x\nX", "#" * 500, "one two three " * 40, "\x0b".join("abcdefghij" * 9)]
    while len(texts) < n:
        body = "\n".join(say(rng.randint(1, 20)) for _ in range(rng.randint(1, 9)))
        if rng.random() < 0.6:
            body += "\n" + (footer.upper() if rng.random() < 0.3 and footer.isascii() else f"  {footer}\t")
        if rng.random() < 0.3:
            body += "\n" + "\n".join(rng.sample(menu, rng.randint(8, 12)))
        texts += [body] * rng.choice([1, 1, 1, 1, 1, 1, 1, 20])
    texts.append(say(60_000))
    return [(k % 997, t, rng.choice(["s", "s", "s", "t", None])) for k, t in enumerate(texts)]


def rule_rows(df):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_rules_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "HOT", 10)
    rows = rule_docs()
    rows += rows[20:24] + [(None, rows[30][1], None)] * 2
    clash = ["id", "host", "k1", "k2", "d1", "key", "line", "lines", "sizes", "lost", "of", "n", "_salt", "_host"]
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in clash]).repartition(5)
    want = plain_rules(rows)
    assert rule_rows(quality_rules.judge(df)) == sorted(want, key=str)
    assert any(not k and not f for *_, f, k, _ in want) and any(lost and k for *_, k, lost in want)
    assert quality_rules.judge(df.limit(0)).collect() == [] and quality_rules.cleaned(df.limit(0)).collect() == []


def test_cleaned_texts_lose_their_frequent_lines(spark):
    rows = rule_docs(9)
    df = spark.createDataFrame(rows, DOCS)
    want = plain_rules(rows)
    kept = Counter((r[0], r[1] - r[-1]) for r in want if r[-2])
    got = Counter((r["doc_id"], len(WORD.findall(r["text"]))) for r in quality_rules.cleaned(df).collect())
    assert set(got) == set(kept)


def plain_codes(rows, parts=8, entries=16, rounds=6, factor=4096):
    ok = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    xs = [[math.floor(factor * float(np.float32(v))) for v in r[1]] for r in ok]
    first = sorted((r[0], x) for r, x in zip(ok, xs, strict=True) if r[0] is not None)[:entries]
    width = len(xs[0]) // parts
    cut = lambda x: [x[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(x)[p] for _, x in first] for p in range(parts)]
    near = lambda b, v: min((sum((a - c) ** 2 for a, c in zip(v, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = defaultdict(list)
            for x in xs:
                mine[near(book, cut(x)[p])[1]].append(cut(x)[p])
            books[p] = [[sum(c) // len(mine[e]) for c in zip(*mine[e], strict=True)] if mine[e] else v for e, v in enumerate(book)]
    out = []
    for r, x in zip(ok, xs, strict=True):
        found = [near(books[p], cut(x)[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    per = Counter()
    for _, label, _, e in out:
        per[label] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(i), code, e, per[label], digest) for i, label, code, e in out)


VECS = "vec_id long, embedding array<float>, label int"


def code_rows(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.mark.parametrize("joined", ["broadcast", "spread"])
def test_codes_against_plain_rounds(spark, monkeypatch, joined):
    if joined == "spread":
        monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(vector_codes, "HOT", 20)
    monkeypatch.setattr(vector_codes, "CHUNK", 50)
    rng = np.random.default_rng(2)
    some = [(int(i), [float(v) for v in rng.normal(0, 0.2, 16).astype(np.float32)], int(rng.integers(0, 4)) if rng.random() < 0.8 else None) for i in rng.permutation(260)]
    some += [(900 + k, [0.25] * 16, 1) for k in range(80)] + [(3, [0.5] * 16, 2), (3, [-0.5] * 16, 2), (None, [0.1] * 16, None)]
    some += [(-1, None, 1), (-2, [float("nan")] * 16, 1), (-3, [None] * 16, 2), (-4, [float("inf")] + [0.0] * 15, None)]
    df = spark.createDataFrame(some, VECS).select("*", *[F.lit(1).alias(c) for c in ("id", "x", "code", "error", "key", "n", "rows", "dim")]).repartition(5)
    assert code_rows(vector_codes.compress(df)) == plain_codes(some)


def test_codes_of_few_or_no_vectors(spark):
    few = [(5, [0.125] * 8, 1), (2, [0.25] * 8, None)]
    assert code_rows(vector_codes.compress(spark.createDataFrame(few, VECS))) == plain_codes(few)
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], VECS)).collect() == []
    for bad in ([(1, [0.5] * 9, 1)], [(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], [(1, [3e38] * 8, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame(bad, VECS))


@pytest.mark.parametrize("kind", ["spread", "ties", "large", "line"])
def test_vantage_tree_equals_all_comparisons(kind):
    rng = np.random.default_rng(7)
    for n in (1, 3, 5, 16, 40):
        if kind == "ties":
            e, x = rng.integers(0, 2, (n, 3)), rng.integers(-1, 3, (500, 3))
        elif kind == "large":
            e, x = rng.integers(-(2**28), 2**28, (n, 8)), rng.integers(-(2**28), 2**28, (500, 8))
        elif kind == "line":
            e, x = np.arange(n)[:, None] * 7, rng.integers(-5, 300, (500, 1))
        else:
            e, x = rng.integers(-900, 900, (n, 8)), rng.integers(-900, 900, (500, 8))
        at, d = vector_codes.nearest(e, vector_codes.vantage_tree(e), x)
        every = ((x[:, None] - e) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (d == every.min(1)).all()
