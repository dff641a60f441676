"""N-gram Jaccard join: grouped prefix join, verified, with the components of its links."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.common import bit_filter, bit_flag, components, drop_stored, few, stored, unwrapped, wrapped
from emberlane.llm.grams import answered, answers, chunked, opened
from emberlane.llm.words import mix, windows, word_hashes

#: Bytes of text whose shingles are counted and signed together, about.
CHUNK = 4 << 20
#: Bytes of a member's hash that verification compares: of n and m members n * m in 2 ** 48 pairs look alike.
WIDTH = 6
#: Bytes of members that are verified together, about.
GROUP = 8 << 20
#: Bits of a shingle's hash in the count table beyond those that number all shingles: one unique shingle in 2 ** SPARE counts as repeated, which costs time, not results.
SPARE = 7
#: Shingles before it in the prefix that a posting carries along.
BEFORE = 4
#: 64-bit words of a set's parity bitmap: bit k is the parity of its members hashed to k, so two bitmaps differ in at most as many bits as the sets in members.
PARITY = 16
_BITS = [f"b{i}" for i in range(PARITY)]
_ENTRY = ["g", "n", "lone", "pos"]


def sets_of(words: np.ndarray, firsts: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text; of the whole sequence where there are fewer words."""
    full = windows(words, n)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        else:
            out.append(windows(words[a:b], int(b - a)) if b > a else full[:0])
    return out


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """:func:`sets_of` UTF-8 texts, lower-cased A-Z."""
    return sets_of(*word_hashes(data, offs, lower=True), n)


def prefix_length(n: int, percent: int) -> int:
    """Two sets that reach the threshold share a shingle among their first so many, in any order common to all."""
    return n - (percent * n + 99) // 100 + 1


def _entries(n: int, bits: int):
    def run(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets = sets_of(words, firsts, n)
        return np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)

    return run


def _narrow(hashes: np.ndarray) -> bytes:
    """The upper :data:`WIDTH` bytes of sorted hashes."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :]).tobytes()


def _wide(data) -> np.ndarray:  # noqa: ANN001
    out = np.zeros((len(data) // WIDTH, 8), dtype=np.uint8)
    out[:, 8 - WIDTH :] = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def _signed(n: int, percent: int, bits: int):
    """What the join has to know of each text; members, prefix and bitmap hold repeated shingles only: no other can be shared."""
    shift, salt = np.uint64(64 - bits), np.uint64(0x5851F42D4C957F2D)

    def run(group: pa.Table) -> pa.Table:
        row, elsewhere = answers(group)
        sets = sets_of(*opened(row), n)
        flat, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        cut_ = flat >> shift
        seen, where, here = np.unique(cut_, return_inverse=True, return_counts=True)
        often = (here + elsewhere)[where]
        of_each = lambda x: np.diff(np.concatenate((np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)))[ends])
        with np.errstate(over="ignore"):
            one, two = of_each(mix(flat)), of_each(mix(flat ^ salt))
        lone = of_each((often == 1).astype(np.int64))
        key, prefix, members, parity = [], [], [], []
        for k, (s, a, b) in enumerate(zip(sets, ends[:-1], ends[1:], strict=True)):
            room = prefix_length(len(s), percent) - int(lone[k]) if lone[k] < len(s) else 0
            if room <= 0:  # the prefix holds unique shingles alone: nothing can link
                key.append(None)
                prefix.append(flat[:0])
                members.append(None)
                continue
            f = often[a:b]
            kept = s[f > 1]
            first = kept[np.lexsort((kept, f[f > 1]))[:room]]
            with np.errstate(over="ignore"):
                key.append(int(mix(mix(first) + np.arange(len(first), dtype=np.uint64)).sum().view(np.int64)))
            prefix.append(first)
            members.append(_narrow(kept))
            parity.append(np.packbits((np.bincount((mix(kept) >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1).astype(np.uint8)))
        longs = lambda x: pa.array(x.view(np.int64))
        wide = np.zeros((len(sets), PARITY), dtype=np.int64)
        if parity:
            wide[[k is not None for k in key]] = np.stack(parity).view(np.int64)
        first = row.column("first")[0].as_py()
        cols = {
            "no": pa.array(np.arange(first, first + len(sets))), "id": row.column("ids").combine_chunks().flatten(), "n": pa.array(np.diff(ends), pa.int32()), "s1": longs(one), "s2": longs(two), "lone": pa.array(lone.astype(np.int32)), "g": pa.array(key, pa.int64()),
            "prefix": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate(prefix).view(np.int64))), "members": pa.array(members, pa.binary()),
        }
        return pa.table(cols | {b: pa.array(np.ascontiguousarray(wide[:, k])) for k, b in enumerate(_BITS)})

    return run


_SIGNED = "no long, id long, n int, s1 long, s2 long, lone int, g long, prefix array<long>, members binary, " + ", ".join(f"{b} long" for b in _BITS)


def _signatures(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Every row's size, set hashes and, where its prefix holds a shingle that another row has too, group, prefix and members.

    Shingles are ordered by the exact number of texts that hold them, so unique ones come first and need no posting.
    """
    chunks = chunked(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", CHUNK)
    words, n_chunks = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bits = min(64, max(32, int(words).bit_length() + SPARE))
    signed = stored(answered(chunks, _entries(n, bits), words, n_chunks, bits).groupBy("chunk").applyInArrow(_signed(n, percent, bits), _SIGNED))
    drop_stored(chunks)
    return signed


def _checked(percent: int):
    """The pairs of one group of sets that reach the threshold."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sets = group.filter(pc.is_valid(group.column("members")))
        place = {no: k for k, no in enumerate(sets.column("u").to_pylist())}
        sizes, members = sets.column("n").to_pylist(), [_wide(m.as_buffer()) for m in sets.column("members")]
        pairs = group.filter(pc.is_valid(group.column("v"))).select(["u", "v"])
        ok = []
        for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), strict=True):
            i, j = place[u], place[v]
            x, y = members[i], members[j]
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            ok.append(100 * both >= percent * (sizes[i] + sizes[j] - both))
        return pairs.filter(pa.array(ok, pa.bool_()))

    return run


def _verify(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of rows whose sets reach the threshold.

    Rows that pairs connect are a family. Small families share a group of about :data:`GROUP` bytes of members; a large one is
    cut into blocks of that size, and a pair of blocks is a group. So a set moves once, or once for each block that its block
    meets, however many pairs it is in, and no task holds more than two blocks.
    """
    family = components(pairs)
    sized = family.join(signed.select(F.col("no").alias("node"), "n"), "node")
    blocks = sized.groupBy("component").agg(F.ceil(F.sum(F.col("n") * WIDTH) / F.lit(float(GROUP))).cast("int").alias("blocks"), F.sum(F.col("n") * WIDTH).alias("bytes"))
    blocks = stored(blocks)
    bundles = (blocks.where("blocks <= 1").agg(F.sum("bytes")).first()[0] or 0) // GROUP + 1
    key = F.when(F.col("blocks") <= 1, F.pmod(F.xxhash64("component"), F.lit(bundles))).otherwise(F.col("component") + F.lit(bundles))
    nodes = family.join(blocks, "component").select("node", key.alias("k"), F.pmod(F.xxhash64("node", F.lit(1)), F.greatest("blocks", F.lit(1))).alias("b"))
    ends = pairs.join(nodes.select(F.col("node").alias("u"), "k", F.col("b").alias("p")), "u").join(nodes.select(F.col("node").alias("v"), F.col("b").alias("q")), "v")
    ends = stored(ends.select("k", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "u", "v"))
    wanted = ends.select("k", "p", "q", "u").union(ends.select("k", "p", "q", "v")).distinct()
    sets = bit_filter(signed.where("members is not null").select("no", "n", "members"), F.col("no"), wanted, "u")
    sides = wanted.join(sets.withColumnRenamed("no", "u"), "u")
    both = sides.select("k", "p", "q", "u", F.lit(None).cast("long").alias("v"), "n", "members").union(ends.select("k", "p", "q", "u", "v", F.lit(None).cast("int"), F.lit(None).cast("binary")))
    groups = both.groupBy("k", "p", "q").applyInArrow(_checked(percent), "u long, v long")
    links = stored(groups.repartition(few(pairs.count())))
    drop_stored(blocks, ends)
    return links


def _groups_reach(a: str, b: str, percent: int):
    """Sizes, unique shingles and, for a shared shingle at ``pos``, what comes before and after it allow a link. Exact: no link fails."""
    best = f"least({a}.pos - {a}.lone, {b}.pos - {b}.lone) + least({a}.n - {a}.pos, {b}.n - {b}.pos)"
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND (100 + {percent}) * ({best}) >= {percent} * ({a}.n + {b}.n)"
        f" AND (100 + {percent}) * ({a}.lone + {b}.lone) <= {100 - percent} * ({a}.n + {b}.n)"
    )


def _first_shared(a: str, b: str, percent: int):
    """What follows the shared shingle at ``pos`` is enough for a link, and none of the few before it in the prefixes is shared.

    Exact for the first shingle that two sets share: no link fails it there. So a pair is met about once, not at each shingle.
    """
    return F.expr(f"(100 + {percent}) * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {percent} * ({a}.n + {b}.n) AND NOT arrays_overlap({a}.before, {b}.before)")


def _members_reach(a: str, b: str, percent: int):
    """Unique shingles and differing bits of the parity bitmaps don't exceed the difference that a link allows. Exact, too."""
    apart = " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in _BITS)
    return F.expr(f"(100 + {percent}) * ({apart} + {a}.lone + {b}.lone) <= {100 - percent} * ({a}.n + {b}.n)")


def _expanded(pairs: DataFrame, units: DataFrame, others: DataFrame, percent: int, also: str) -> DataFrame:
    """Pairs of members (u, v) of pairs of groups (g, n), (h, m) that the members' bitmaps allow."""
    y = others.select(F.col("g").alias("h"), F.col("n").alias("m"), F.struct(*others.columns).alias("y"))
    x = pairs.join(units.select("g", "n", F.struct(*units.columns).alias("x")), ["g", "n"]).join(y, ["h", "m"])
    x = x.where("x.uid != y.uid").where(also).where(_members_reach("x", "y", percent))
    return x.select(F.least("x.uid", "y.uid").alias("u"), F.greatest("x.uid", "y.uid").alias("v")).distinct()


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: ``id_col`` (long), n_shingles, component_id (smallest id reachable by links, itself included).

    Documents link when ``100 * intersection >= percent * union`` of their sets of ``shingle``-word shingles (words
    lower-cased A-Z). Shingles are ordered by how many texts hold them, counted exactly over all texts. Those that one text
    alone holds come first and can match nothing, so a prefix is its repeated shingles, and most texts have none. Documents
    with equal prefixes and sizes form a group, a single entry in the postings. Pairs of groups that share a prefix shingle
    are filtered by sizes, places in the prefixes and numbers of unique shingles; surviving pairs are expanded to their
    members (distinct sets), filtered by parity bitmaps (:data:`PARITY`), and verified on whole sets.

    That runs twice. First every group meets just its own first member and the group it shares most shingles with among
    those that head its shingles' lists; what links becomes components, so groups of very many near copies collapse in
    linear work. Then all pairs of groups that aren't yet wholly within one component are formed (a shingle's groups
    outside its head's component against all others, sizes within reach of each other as join key, a pair only where it may
    share its first shingle) and their members in different components verified. So no link between components is lost, and pairs within one, which can add nothing,
    are not made.

    Sets without members (null text, no words) link with nothing. A null id takes no part: its component is null. Rows that
    repeat an id, with equal or other texts, count as rows of their own, and the smallest id of all that they reach is the
    answer of each. Extra columns are ignored; an empty table gives an empty result.
    """
    signed = _signatures(docs, id_col, text_col, shingle, percent)
    real = signed.where("g is not null and id is not null")
    units = stored(real.groupBy("s1", "s2", "n", "g").agg(F.min("no").alias("uid"), F.min("id").alias("least"), F.min("lone").alias("lone"), *[F.min(b).alias(b) for b in _BITS]))
    groups = real.groupBy("g", "n").agg(F.min_by(F.struct("prefix", "lone"), "no").alias("p"))
    lists = groups.select("g", "n", "p.lone", "p.prefix", F.posexplode("p.prefix").alias("at", "tok"))
    before = F.slice("prefix", F.greatest(F.col("at") - (BEFORE - 1), F.lit(1)), F.least(F.col("at"), F.lit(BEFORE)))
    lists = lists.select("g", "n", "lone", "tok", (F.col("at") + F.col("lone")).alias("pos"), before.alias("before"))
    entry = F.struct(*_ENTRY)
    heads = lists.groupBy("tok").agg(F.count(F.lit(1)).alias("c"), F.min_by(entry, F.xxhash64("g", "n")).alias("head")).where("c > 1")
    posted = stored(lists.join(heads.select("tok", "head"), "tok").select("tok", "head", *_ENTRY, "before"))
    members = units.select("g", "n", "uid", "lone", *_BITS)
    firsts = members.groupBy("g", "n").agg(F.min_by(F.struct("uid", "lone", *_BITS), F.xxhash64("uid")).alias("f")).select("g", "n", "f.*")

    met = posted.where("g != head.g or n != head.n").select(entry.alias("x"), F.col("head").alias("y")).where(_groups_reach("x", "y", percent))
    tally = met.groupBy(F.col("x.g").alias("g"), F.col("x.n").alias("n"), F.col("y.g").alias("h"), F.col("y.n").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    best = tally.groupBy("g", "n").agg(F.max(F.struct("c", "h", "m")).alias("b")).select("g", "n", "b.h", "b.m")
    own = members.groupBy("g", "n").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g", "n", F.col("g").alias("h"), F.col("n").alias("m"))
    tried = stored(_expanded(best.union(own), members, firsts, percent, "true"))
    links = _verify(tried, signed, percent)

    named = members.join(components(links).withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("component", "uid")).drop("component")
    named = stored(named)
    whole = named.groupBy("g", "n").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    posted_in = posted.drop("head").join(whole, ["g", "n"])
    mains = posted_in.groupBy("tok").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("lo", F.xxhash64("g", "n")).alias("main")).where("lo != hi").select("tok", "main")
    open_lists = posted_in.join(mains, "tok").withColumn("band", F.floor(F.log("n") / F.lit(math.log(100 / percent) + 1e-6)).cast("int"))
    open_lists = stored(open_lists.select("tok", "main", "band", "lo", "hi", F.struct(*_ENTRY, "before").alias("e")))
    left = open_lists.where("lo != main or hi != main").select("tok", "lo", "hi", F.col("e").alias("x"), F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"))
    right = open_lists.select("tok", "band", F.col("main"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("e").alias("y"))
    apart = "(lo != hi or lo2 != hi2 or lo != lo2) and (x.g, x.n) != (y.g, y.n) and ((lo2 = main and hi2 = main) or (x.g, x.n) < (y.g, y.n))"
    pairs = left.join(right, ["tok", "band"]).where(apart).where(_groups_reach("x", "y", percent) & _first_shared("x", "y", percent))
    pairs = pairs.select(F.col("x.g").alias("g"), F.col("x.n").alias("n"), F.col("y.g").alias("h"), F.col("y.n").alias("m")).distinct()
    within = whole.where("lo != hi").select("g", "n", F.col("g").alias("h"), F.col("n").alias("m"))
    rest = _expanded(pairs.union(within), named, named, percent, "x.comp != y.comp").join(tried, ["u", "v"], "left_anti")
    rest = stored(rest)
    links = links.union(_verify(rest, signed, percent))

    comp = components(links).withColumnRenamed("node", "uid")
    labelled = units.select("s1", "s2", "n", "uid", "least").join(comp, "uid", "left").withColumn("comp", F.coalesce("component", "uid"))
    least = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_set = stored(labelled.join(least, "comp").select("s1", "s2", "n", "component_id"))
    drop_stored(posted, open_lists, tried, rest, named, units)
    shown = lambda df, c: df.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), c.alias("component_id"))
    alone = signed.where("g is null or id is null")
    grouped = signed.where("g is not null and id is not null").select("id", "n", "s1", "s2").join(by_set, ["s1", "s2", "n"])
    return shown(alone, F.col("id")).union(shown(grouped, F.col("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, one of each component: the one with the component's smallest id. All columns as they were.

    Where ids are null or repeated, rows are numbered and linked by number: of linked rows under one id, or all without an
    id, one stays.
    """
    if docs.groupBy(F.col(id_col)).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count():
        return _one_row_of_each(docs, id_col, text_col, shingle, percent)
    named = linked_components(docs, id_col, text_col, shingle, percent).where(F.col("component_id") != F.col(id_col))
    losers = stored(named.select(F.col(id_col).alias("id")).distinct())
    flagged = bit_flag(wrapped(docs, own=F.col(id_col).cast("long")), F.col("own"), losers, "id", "_may")
    rest = flagged.where("_may").join(losers, F.col("own") == F.col("id"), "left_anti")
    return unwrapped(flagged.where("not _may").select("_row").unionByName(rest.select("_row")), docs)


def _one_row_of_each(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    rows = stored(wrapped(docs, own=F.col(id_col).cast("long"), text=F.col(text_col), no=F.monotonically_increasing_id()))
    linked = linked_components(rows.select("no", "text"), "no", "text", shingle, percent).select("no", "component_id")
    rank = F.struct(F.col("own").isNull().alias("none"), "own", "no")
    firsts = linked.join(rows.select("no", "own"), "no").groupBy("component_id").agg(F.min(rank).alias("first")).select(F.col("first.no").alias("no"))
    losers = stored(linked.select("no").join(firsts, "no", "left_anti"))
    flagged = bit_flag(rows, F.col("no"), losers, "no", "_may")
    rest = flagged.where("_may").join(losers, "no", "left_anti")
    return unwrapped(flagged.where("not _may").select("_row").unionByName(rest.select("_row")), docs)
