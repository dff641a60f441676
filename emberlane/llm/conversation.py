"""Conversation structure repair: cheapest edits to a grammar of roles, by a recursive DuckDB query over batches of conversations."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of text that make a batch of whole conversations, about; rows of a partition, about.
BATCH_ROWS, BATCH_BYTES, PARTITION_ROWS = 20_000, 8 << 20, 40_000
#: Memory that DuckDB may take in a task.
MEMORY = "512MB"
#: Fixed values of the grammar ``(s?(ua)+)?``: states are 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
KEEP_S, KEEP_U, KEEP_A, OTHER = {0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {}
#: Fixed costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 2, 3, 2, 1
NAMES = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")

_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # the state after the user's or assistant's turn that may follow


def _row_options(state: int) -> str:
    """SQL list of (cost, audit) for deleting, keeping or reroling the row whose code is ``k``, from ``state``."""
    stay = f"CASE WHEN k BETWEEN 'A' AND 'Z' THEN {STAYS_TRUNCATED} ELSE 0 END"
    options = [f"{{'c': b{state}.c + {DELETE}, 'a': 'D' || b{state}.a}}"]
    for letter, keep in (("s", KEEP_S), ("u", KEEP_U), ("a", KEEP_A)):
        if state in keep:
            to = keep[state]
            options.append(f"CASE WHEN lower(k) = '{letter}' THEN {{'c': b{to}.c + {stay}, 'a': 'K' || b{to}.a}} END")
    to = _NEXT[state]
    options.append(f"CASE WHEN k <> '-' THEN {{'c': b{to}.c + {REROLE} + {stay}, 'a': 'R' || b{to}.a}} END")
    return f"list_min([{', '.join(options)}])"


def _with_inserts(state: int) -> str:
    one, two = _NEXT[state], _NEXT[_NEXT[state]]
    return (
        f"list_min([e{state}, {{'c': e{one}.c + {INSERT}, 'a': 'I' || e{one}.a}},"
        f" {{'c': e{two}.c + {2 * INSERT}, 'a': 'II' || e{two}.a}}]) AS b{state}"
    )


#: Over table ``batch`` (no, i: places of conversation and row from 0; turn, role, text; gone: a row that damage dropped).
#: ``codes`` has a letter a row: '-' must go, else s, u, a or o (other) for its role, as a capital where it is truncated.
REPAIR_SQL = f"""
WITH RECURSIVE marked AS (
    SELECT no, i, turn, role, text, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
           row_number() OVER (PARTITION BY no, role, text ORDER BY i) > 1 AS again
    FROM batch WHERE NOT gone),
rated AS (
    SELECT *, CASE WHEN solid = '' THEN 'b' WHEN again THEN 'd' WHEN right(solid, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
           CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS part,
           lag(left(role, 1)) OVER (PARTITION BY no ORDER BY i) || left(role, 1) AS pair
    FROM marked),
coded AS (
    SELECT *, CASE WHEN fault IN ('b', 'd') THEN '-' WHEN fault = 't' THEN upper(part) ELSE part END AS k FROM rated),
whole AS (
    SELECT no, count(*) AS n, string_agg(k, '' ORDER BY i) AS codes,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM coded GROUP BY no),
best(no, codes, i, b0, b1, b2, b3) USING KEY (no) AS (
    SELECT no, codes, n AS i, {{'c': 0::BIGINT, 'a': ''}} AS b0, {{'c': {2 * INSERT}::BIGINT, 'a': 'II'}} AS b1,
           {{'c': {INSERT}::BIGINT, 'a': 'I'}} AS b2, {{'c': 0::BIGINT, 'a': ''}} AS b3
    FROM whole
    UNION
    SELECT no, codes, i, {', '.join(_with_inserts(s) for s in range(4))}
    FROM (SELECT no, codes, i, {', '.join(f'{_row_options(s)} AS e{s}' for s in range(4))}
          FROM (SELECT no, codes, i - 1 AS i, substr(codes, i, 1) AS k, b0, b1, b2, b3 FROM best WHERE i > 0))),
plan AS (SELECT no, b0.c AS cost, b0.a AS audit FROM best WHERE i = 0),
step AS (
    SELECT no, p, substr(audit, p, 1) AS edit
    FROM (SELECT no, audit, unnest(range(1, length(audit) + 1)) AS p FROM plan)),
placed AS (
    SELECT no, p, edit, count(*) FILTER (edit <> 'I') OVER w - 1 AS i, count(*) FILTER (edit <> 'D') OVER w - 1 AS j
    FROM step WINDOW w AS (PARTITION BY no ORDER BY p ROWS UNBOUNDED PRECEDING)),
built AS (
    SELECT x.no, x.p, x.edit, x.j, c.role, CASE WHEN x.edit = 'I' THEN '' ELSE c.text END AS text,
           max(CASE WHEN x.j = 0 AND x.edit = 'K' AND c.part = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.no) AS lead
    FROM placed x LEFT JOIN coded c ON x.edit <> 'I' AND c.no = x.no AND c.i = x.i WHERE x.edit <> 'D'),
told AS (
    SELECT no, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS repaired
    FROM built GROUP BY no)
SELECT w.no, w.gaps, w.blank, w.duplicate, w.truncated, w.illegal, p.cost, p.audit, coalesce(t.repaired, '') AS repaired
FROM whole w JOIN plan p USING (no) LEFT JOIN told t USING (no)
"""


def repair_batch(table: pa.Table) -> pa.Table:
    """:data:`REPAIR_SQL` over one batch, in an in-memory database of one thread that spills nowhere."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    try:
        con.register("batch", table)
        return con.sql(REPAIR_SQL).to_arrow_table()
    finally:
        con.close()


def _numbered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows with the places of their conversation (``no``) and of themselves in it (``i``); where conversations begin."""
    conv = table.column("conv").combine_chunks()
    null = conv.is_null().to_numpy(zero_copy_only=False)
    same = pc.fill_null(pc.equal(conv.slice(1), conv.slice(0, len(conv) - 1)), False).to_numpy(zero_copy_only=False) | (null[1:] & null[:-1])
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    no = np.cumsum(np.concatenate(([True], ~same))) - 1
    return table.append_column("no", pa.array(no)).append_column("i", pa.array(np.arange(len(no)) - first[no])), first


def _repaired(names: list[str]):
    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, first = _numbered(table)
        convs = table.column("conv").combine_chunks().take(pa.array(first))
        found = repair_batch(rows.drop_columns(["conv"]))
        at = np.full(len(convs), -1)
        at[found.column("no").to_numpy()] = np.arange(found.num_rows)
        some = pa.array(np.where(at < 0, 0, at), mask=at < 0)
        cols = [pc.fill_null(found.column(c).cast(pa.string() if c in ("audit", "repaired") else pa.int64()).take(some), "" if c in ("audit", "repaired") else 0) for c in NAMES[1:]]
        yield from pa.table([convs, *cols], names=names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BATCH_ROWS and sum(b.nbytes for b in held) < BATCH_BYTES:
                continue
            table = pa.Table.from_batches(held)
            cut = int(_numbered(table)[1][-1])  # the last conversation may go on
            if cut:
                yield from answer(table.slice(0, cut))
                held = pa.Table.from_batches(held).slice(cut).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield from answer(pa.Table.from_batches(held))

    return run


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    A conversation's rows are taken by turn (nulls first; ties by role and text). ``gaps`` are turns missing between its first
    and last; then rows by their first fault: blank, role and text as seen earlier, not ending in ``.``, ``!`` or ``?``;
    ``illegal`` are neighbours whose roles may not follow each other. ``audit`` has the initials (Keep, Rerole, Delete, Insert)
    of the cheapest edits that make the roles' initials ``(s?(ua)+)?``, the first in ASCII order among equals; ``repaired`` is
    the outcome, ``role:text`` joined by new lines.

    Conversations are dealt by hash and sorted, so a task streams them in batches of whole conversations, each one recursive
    DuckDB query (:data:`REPAIR_SQL`): a recursion goes one turn back in all of the batch's conversations at once and keeps the
    minimum cost and its audit for each state of the grammar. Going back, an audit is complete to its end, so comparing strings
    is exact. Memory is bounded by a batch and one conversation; that is one row of the result anyway, its text is one string.
    Time grows with the square of a conversation's length, as audits are strings.

    A null role or text is one space; rows of a null id are one conversation; a row listed twice is a duplicate. Rows marked by
    ``gone_col`` only name their conversation: one without other rows has zeros, an empty audit and an empty text. An empty
    table gives an empty result.
    """
    col = lambda c: F.col(f"`{c}`")
    gone = F.coalesce(col(gone_col), F.lit(False)) if gone_col else F.lit(False)
    own = rows.select(
        col(conv_col).alias("conv"), col(turn_col).cast("long").alias("turn"), F.coalesce(col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(col(text_col), F.lit(" ")).alias("text"), gone.alias("gone"),
    )
    dealt = own.repartition(own.count() // PARTITION_ROWS + 8, "conv").sortWithinPartitions("conv", "gone", "turn", "role", "text")
    kind = rows.schema[conv_col].dataType
    whole = lambda c: T.StructField(c, T.StringType() if c in ("audit", "repaired") else T.LongType())
    out = T.StructType([T.StructField(conv_col, kind), *map(whole, NAMES[1:])])
    return dealt.mapInArrow(_repaired(out.fieldNames()), out)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with seeded faults, by crc32 of ``conv_id:turn`` modulo 20: (conv_id, turn, role, text, gone).

    0 drops the row (it stays as ``gone``, naming its conversation), 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3
    repeats it, 4 makes its role user. Nulls read as one space, but a null turn or id stays null.
    """
    text_of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text_of(conv_col), text_of(turn_col)).cast("binary")) % 20
    own = rows.select(F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").alias(turn_col), text_of(role_col).alias("role"), text_of(text_col).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select(
        conv_col, turn_col, F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") == 0).alias("gone"), F.explode(times).alias("copy"),
    ).drop("copy")
