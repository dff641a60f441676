"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to the n-grams of the texts, summed per document."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.llm.common import drop_stored, stored
from emberlane.llm.grams import answered, answers, chunked, counts_elsewhere, cut, gathered, packed, same_runs, unpacked, vocabulary  # noqa: F401 - tests take same_runs from here
from emberlane.llm.words import mix

ALPHA = 0.4
#: Words that are scored at a time.
BLOCK = 1 << 17
#: N-grams of a count partition, about; words that occur more often don't keep the n-grams that begin with them together.
PARTITION, HOT = 2_500_000, 100_000


def _ordered(key: np.ndarray, top: int) -> np.ndarray:
    """An order of numbers up to ``top``, equal ones by their place; key and place are sorted as one number where that has 64 bits."""
    low = len(key).bit_length()
    if int(top).bit_length() + low > 64:
        return np.argsort(key, kind="stable")
    both = key.astype(np.uint64)
    both <<= np.uint64(low)
    both |= np.arange(len(key), dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << low) - 1)
    return both.view(np.int64)


def _heads(values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    head = np.ones(len(values), dtype=bool)
    head[1:] = values[1:] != values[:-1]
    return head


def _word_entries(bits: int):
    """A chunk's different words as the count table takes them: so many bits of their hashes sort them, 32 more are compared."""

    def run(words: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
        known, counts = np.unique(words, return_counts=True)
        return [known >> np.uint64(64 - bits), counts] + ([known & np.uint64(0xFFFFFFFF)] if bits < 64 else [])

    return run


def _word_numbers(parts: int):
    """For every chunk's words in one partition of the count table, their counts in all other chunks and numbers for the whole
    corpus: frequent words have small ones, and no two partitions share one."""

    def run(group: pa.Table) -> pa.Table:
        sizes, counts, order, begin = gathered(group)
        rank = np.empty(len(begin), dtype=np.int64)
        rank[np.argsort(-np.add.reduceat(counts[order], begin).astype(np.int64), kind="stable")] = np.arange(len(begin))
        number = np.empty(len(counts), dtype=np.int64)
        number[order] = np.repeat(rank * parts + group.column("p")[0].as_py(), np.diff(begin, append=len(counts)))
        own = {c: group.column(c) for c in ("chunk", "p", "m")}
        return pa.table(own | {"rest": cut(counts_elsewhere(counts, order, begin), sizes), "number": cut(number, sizes)})

    return run


PLACED_TYPE = "chunk long, ids array<{id}>, n long, sizes binary, codes binary, known long, places binary"
CODED_TYPE = "chunk long, ids array<{id}>, n long, sizes binary, codes binary, known long, shared long, numbers binary, elsewhere binary"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the places of their words in order of the hashes instead of the hashes: what it takes to read the answers."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = pa.Table.from_batches([batch.slice(r, 1)])
            vocab = vocabulary(row)[0]
            places = np.empty(len(vocab), dtype=np.int64)
            places[np.argsort(vocab)] = np.arange(len(vocab))
            new = {"known": pa.array([len(vocab)], pa.int64()), "places": pa.array([packed(places)], pa.binary())}
            yield from pa.table({c: row.column(c) for c in ("chunk", "ids", "n", "sizes", "codes")} | new).to_batches()


def _coded(group: pa.Table) -> pa.Table:
    """A chunk with its words coded in order of their numbers in the corpus; words that no other chunk has come last and have none."""
    row, rest = answers(group)
    number = answers(group, "number")[1]
    get = lambda c: row.column(c)[0].as_py()
    order = np.argsort(np.where(rest > 0, number, np.iinfo(np.int64).max), kind="stable")
    code, shared = np.empty(len(order), dtype=np.int64), int((rest > 0).sum())
    code[order] = np.arange(len(order))
    codes = code[unpacked(get("places"), get("known")).astype(np.int64)][unpacked(get("codes"), get("n")).astype(np.int64)]
    few = order[:shared]
    new = {"codes": packed(codes), "shared": shared, "numbers": packed(np.diff(number[few], prepend=0)), "elsewhere": packed(rest[few])}
    out = {c: row.column(c) for c in ("chunk", "ids", "n", "sizes", "known")} | {c: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for c, v in new.items()}
    return pa.table(out)


class Chunk:
    """The n-grams of a coded chunk: for each length up to ``order`` their number at each word that ends one (-1 where the text has
    too few words before), a word that ends each different one, and its count; numbers follow the words' codes."""

    def __init__(self, row: pa.Table, order: int) -> None:
        get = lambda c: row.column(c)[0].as_py()
        ints = lambda c, n: unpacked(get(c), n).astype(np.int64)
        self.codes, self.known, self.shared = ints("codes", get("n")), get("known"), get("shared")
        self.firsts = np.concatenate(([0], np.cumsum(ints("sizes", len(row.column("ids")[0])))))
        self.numbers, self.elsewhere = np.cumsum(ints("numbers", self.shared)), ints("elsewhere", self.shared)
        counts = np.bincount(self.codes, minlength=self.known)
        self.total = counts[: self.shared] + self.elsewhere
        place = np.arange(len(self.codes)) - np.repeat(self.firsts[:-1], np.diff(self.firsts))
        self.which, self.ends, self.counts = [self.codes], [None], [counts]
        for n in range(2, order + 1):
            some = np.flatnonzero(place >= n - 1)
            key = self.which[-1][some - 1] * self.known + self.codes[some]
            at = _ordered(key, len(self.counts[-1]) * self.known)
            head = _heads(key[at])
            which = np.full(len(self.codes), -1)
            which[some[at]] = np.cumsum(head) - 1
            begin = np.flatnonzero(head)
            self.which.append(which)
            self.ends.append(some[at[begin]])
            self.counts.append(np.diff(begin, append=len(key)))

    def dealt(self, n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a length whose words all occur in other chunks, by count partition and then by their words; where each
        partition begins. N-grams stay with others of their first words up to the first that isn't hot, so a partition holds few of any."""
        ends = self.ends[n - 1]
        words = [self.codes[ends - n + 1 + j] for j in range(n)]
        some = np.flatnonzero(np.logical_and.reduce([w < self.shared for w in words]))
        hashes, often = mix(self.numbers.astype(np.uint64) + np.uint64(1)), self.total > HOT
        key = hashes[words[0][some]]
        hot = np.flatnonzero(often[words[0][some]])
        for j in range(1, n):
            w = words[j][some[hot]]
            key[hot] = mix(key[hot] * np.uint64(3) + hashes[w])
            hot = hot[often[w]]
        part = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        at = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        return some[at], np.searchsorted(part[at], np.arange(parts + 1, dtype=np.uint64))


def _dealt(order: int, parts: int):
    """A chunk's n-grams of two words and more for each count partition: columns of word numbers, each the gap to the row before
    where all columns to its left are the same, and counts less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                chunk = Chunk(pa.Table.from_batches([batch.slice(r, 1)]), order)
                for n in range(2, order + 1):
                    grams, at = chunk.dealt(n, parts)
                    full = np.flatnonzero(np.diff(at))
                    same = np.ones(len(grams), dtype=bool)
                    same[at[full]] = False
                    cols = []
                    for j in range(n):
                        number = chunk.numbers[chunk.codes[chunk.ends[n - 1][grams] - n + 1 + j]]
                        before = np.concatenate(([0], number))[:-1]
                        cols.append(number - np.where(same, before, 0))
                        same &= number == before
                    cols.append(chunk.counts[n - 1][grams] - 1)
                    for some in np.array_split(full, max(1, len(full) // 64)):
                        blobs = [packed(c[at[p] : at[p + 1]]) for p in some for c in cols]
                        packs = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * (n + 1), pa.int32()), pa.array(blobs, pa.binary()))
                        same_for_all = [pa.array(np.full(len(some), v)) for v in (batch.column("chunk")[r].as_py(), n)]
                        yield pa.RecordBatch.from_arrays([same_for_all[0], pa.array(some.astype(np.int32)), same_for_all[1], pa.array(np.diff(at)[some]), packs], names=["chunk", "p", "order", "m", "packs"])

    return run


def _opened_entries(group: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    """Rows' numbers of entries, and the columns of word numbers and of counts of n-grams of one length."""
    sizes, packs = group.column("m").to_pylist(), group.column("packs").to_pylist()
    cols = [np.concatenate([unpacked(b[j], m) for b, m in zip(packs, sizes, strict=True)]).astype(np.int64) for j in range(len(packs[0]))]
    head = np.zeros(len(cols[0]), dtype=bool)
    head[np.cumsum([0, *sizes[:-1]])] = True
    for j in range(len(cols) - 1):
        run, begin = np.cumsum(cols[j]), np.flatnonzero(head)
        cols[j] = run - np.repeat(run[begin] - cols[j][begin], np.diff(begin, append=len(run)))
        head |= _heads(cols[j])
    return sizes, [*cols[:-1], cols[-1] + 1]


def _together(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows of word numbers side by side, and where in it a new one begins."""
    key, top = words[0], int(words[0].max())
    for w in words[1:]:
        wide = int(w.max()) + 1
        if (top + 1) * wide > 1 << 62:  # number what there is so far
            at = _ordered(key, top)
            dense = np.empty_like(key)
            dense[at] = np.cumsum(_heads(key[at])) - 1
            key, top = dense, len(key)
            if (top + 1) * wide > 1 << 62:
                raise OverflowError("a count partition holds too many n-grams")
        key, top = key * wide + w, (top + 1) * wide - 1
    at = _ordered(key, top)
    return at, np.flatnonzero(_heads(key[at]))


def _totals(group: pa.Table) -> pa.Table:
    """One partition of the count table: for every chunk's n-grams in it, their counts in all other chunks."""
    out, orders = [], np.asarray(group.column("order"))
    for n in np.unique(orders):
        rows = group.filter(pa.array(orders == n))
        sizes, (*words, counts) = _opened_entries(rows)
        rest = cut(counts_elsewhere(counts, *_together(words)), sizes)
        out.append(pa.table({c: rows.column(c) for c in ("chunk", "p", "order", "m")} | {"rest": rest}))
    return pa.concat_tables(out)


def _blocks(firsts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of texts of about :data:`BLOCK` words."""
    out, a = [], 0
    while a < len(firsts) - 1:
        b = max(a + 1, int(np.searchsorted(firsts, firsts[a] + BLOCK, side="right")) - 1)
        out.append((a, b))
        a = b
    return out


def score_words(ends: list[np.ndarray], firsts: np.ndarray, total: np.ndarray, alpha: float, n_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum of word scores and number of words that back off; ``total`` are the corpus's counts of the n-grams that ``ends`` number."""
    order, n_own = len(ends), np.diff(firsts)
    doc = np.repeat(np.arange(len(n_own)), n_own)
    rest = (n_all - n_own)[doc]
    others = []
    for which in ends:
        some = np.flatnonzero(which >= 0)
        at = which[some]
        key = doc[some] * np.int64(len(total) + 1) + at
        order_of = _ordered(key, len(n_own) * (len(total) + 1))
        begin = np.flatnonzero(_heads(key[order_of]))
        own = np.empty(len(some), dtype=np.int64)
        own[order_of] = np.repeat(lengths := np.diff(begin, append=len(some)), lengths)
        rest_of = np.zeros(len(which), dtype=np.int64)
        rest_of[some] = total[at] - own
        others.append(rest_of)
    longest = np.minimum(order, np.arange(len(doc)) - firsts[:-1][doc] + 1)
    score, used = np.zeros(len(doc)), np.zeros(len(doc), dtype=np.int64)
    for n in range(order, 0, -1):
        below = np.concatenate(([1], others[n - 2][:-1])) if n > 1 else rest  # the context ends at the word before
        take = (used == 0) & (longest >= n) & (others[n - 1] > 0)
        if (below[take] < others[n - 1][take]).any():
            raise ArithmeticError("an n-gram is counted more often than its context")
        score[take] = np.log(alpha) * (longest[take] - n) + np.log(others[n - 1][take] / below[take])
        used[take] = n
    new = used == 0
    score[new] = np.log(alpha) * longest[new] - np.log(rest[new] + 1.0)
    return np.bincount(doc, weights=score, minlength=len(n_own)).astype(float), np.bincount(doc, weights=used < longest, minlength=len(n_own)).astype(np.int64)


def _scored(order: int, alpha: float, n_all: int, parts: int, schema: T.StructType):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("order", "ascending"), ("p", "ascending")])
        own_row = group.slice(0, 1)
        chunk, orders = Chunk(own_row, order), np.asarray(group.column("order"))
        firsts = chunk.firsts
        total = [chunk.counts[0]]
        total[0][: chunk.shared] = chunk.total
        for n in range(2, order + 1):
            rows = group.filter(pa.array(orders == n))
            rest = [unpacked(b.as_buffer(), m.as_py()) for b, m in zip(rows.column("rest"), rows.column("m"), strict=True)]
            total.append(chunk.counts[n - 1].copy())
            total[-1][chunk.dealt(n, parts)[0]] += np.concatenate(rest or [np.zeros(0, np.uint64)]).astype(np.int64)
        base = np.cumsum([0, *map(len, total)])
        ends, total = [np.where(w < 0, -1, w + b) for w, b in zip(chunk.which, base[:-1], strict=True)], np.concatenate(total)
        parts_of = [score_words([e[firsts[a] : firsts[b]] for e in ends], firsts[a : b + 1] - firsts[a], total, alpha, n_all) for a, b in _blocks(firsts)]
        sums, backed = (np.concatenate(c) for c in zip(*parts_of, strict=True))
        n_own = np.diff(firsts)
        mean = np.where(n_own > 0, sums / np.maximum(n_own, 1), np.nan)
        ids = own_row.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(n_own), pa.array(backed), pa.array(sums), pa.array(mean, from_pandas=True)], names=schema.names)

    return run


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = ALPHA, bits: int = 64) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_backed_off, log_score (sum over words), mean_log_score.

    Counts come from all other documents: a document's own occurrences are taken out, so nothing vouches for itself. A
    word's score is count(n-gram) / count(context) for the longest n-gram (up to ``order``, within the document) that
    occurs elsewhere, times ``alpha`` for each step of backing off; at one word, count / all words elsewhere; a word seen
    nowhere else scores ``alpha ** longest / (words elsewhere + 1)``.

    Words are counted and numbered first: a chunk's different words with their counts go to the partitions of their hashes,
    which add up and answer with counts elsewhere and numbers. The count table of longer n-grams is partitioned by hash and
    joined to the n-grams of the texts a chunk at a time: a chunk's distinct n-grams with their counts go to their partitions
    (one row per chunk, partition and length, holding sorted rows of word numbers as gaps), which add up and answer; the
    chunk then scores its words and sums them by document. N-grams with a word that no other chunk has stay at home, for
    they occur nowhere else. Entries grow with the n-grams, so does the number of partitions, and no task's share grows with
    the corpus. The number of rows grows faster, with chunks times partitions, until each holds a single n-gram: it never
    exceeds the number of n-grams.

    N-grams are compared word by word, as whole sequences of word numbers; words are told apart by 64 bits (``bits`` of them
    sort a word's hash, and where that is less, 32 more of its bits are compared). A count above its context's, which a
    mix-up would show, raises. Words are lower-cased A-Z. Null or empty texts have no words, log_score 0 and a null mean; repeated
    rows and rows with null or repeated ids count as separate documents; an empty table gives an empty result.
    """
    chunks = chunked(docs, id_col, text_col, word_bits=64)
    n_all, n_chunks, n_known = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.length("vocab")), F.lit(0)) / 8).first()
    kind = docs.schema[id_col].dataType
    placed = chunks.mapInArrow(_placed, PLACED_TYPE.format(id=kind.simpleString()))
    words = answered(chunks, _word_entries(bits), int(n_known), n_chunks, bits, _word_numbers, "rest binary, number binary", placed)
    coded = stored(words.groupBy("chunk").applyInArrow(_coded, CODED_TYPE.format(id=kind.simpleString())))
    drop_stored(chunks)
    parts = max(8, n_all * (order - 1) // PARTITION + 1)
    dealt = coded.mapInArrow(_dealt(order, parts), "chunk long, p int, order long, m long, packs array<binary>").repartition(parts, "p")
    totals = dealt.groupBy("p").applyInArrow(_totals, "chunk long, p int, order long, m long, rest binary")
    both = coded.withColumn("order", F.lit(0).cast("long")).withColumn("p", F.lit(-1)).unionByName(totals, allowMissingColumns=True)
    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_words", T.LongType()), T.StructField("n_backed_off", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType())])
    return both.repartition(max(1, n_chunks), "chunk").groupBy("chunk").applyInArrow(_scored(order, alpha, n_all, parts, out), out)
