"""Token counts: Arrow batches encoded by bytes, lengths only; long texts split at safe boundaries."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of more characters are split; a call to the library gets about so many bytes.
SPLIT_AT, BATCH = 32_768, 1 << 19
_loaded: dict[str, object] = {}


def _safe_cut(text: str, at: int) -> int:
    """The first place from ``at`` on where a lone cut is safe: a space after a character that is no space; -1 if none.

    No piece of the vocabulary holds a space mark behind another character, so no merge reaches over such a place; the
    space itself is dropped, as the library puts one before each part.
    """
    while (at := text.find(" ", at)) > 0:
        if text[at - 1] not in " ▁" and at + 1 < len(text):
            return at
        at += 1
    return -1


def split_text(text: str, limit: int = SPLIT_AT) -> list[str]:
    parts, begin = [], 0
    while len(text) - begin > limit and (at := _safe_cut(text, begin + limit)) > 0:
        parts.append(text[begin:at])
        begin = at + 1
    return [*parts, text[begin:]]


def _counter(path: str):
    """A function from texts to token counts, one model per worker process."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
            _loaded[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), not inner
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[path] = (lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]), False
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_tokens as the library for ``path`` counts them, nothing added.

    Null counts as empty (0 tokens). Long texts are split only where the vocabulary shows that no merge can cross, so
    counts are those of whole texts; a text without such a place and, with a .json file, every text stays whole. One narrow
    pass: no shuffle, and batches balanced by bytes rather than rows bound the memory of a worker. Null and repeated ids are
    answered row by row; extra columns, whatever their names, have no effect; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, can_split = _counter(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            total = [0] * batch.num_rows
            n_bytes, owner, parts, held = [0] * batch.num_rows, [], [], 0

            def flush() -> None:
                for i, n in zip(owner, count(parts), strict=True):
                    total[i] += n
                owner.clear()
                parts.clear()

            for i, value in enumerate(texts):
                text = value.as_py() or ""
                n_bytes[i] = len(text) if text.isascii() else len(text.encode())
                for part in split_text(text) if can_split and len(text) > SPLIT_AT else [text]:
                    owner.append(i)
                    parts.append(part)
                    held += n_bytes[i] * len(part) // max(1, len(text))
                    if held >= BATCH:
                        flush()
                        held = 0
            if parts:
                flush()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(total, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
