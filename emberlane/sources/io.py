"""Readers and writers: Parquet, CSV, JSON lines, probe sets, digests, provenance."""
from __future__ import annotations

import datetime
import hashlib
import json
import platform
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.contracts import assert_unique, require_columns
from emberlane.operators.sampling import numbered


def frame(spark: SparkSession, source: DataFrame | str, columns: Sequence[str] | None = None) -> DataFrame:
    """A frame as it is, or a Parquet path read with just the columns asked for."""
    df = spark.read.parquet(source) if isinstance(source, str) else source
    return df.select(*columns) if columns else df


#: Rows of a sheet that is written as one file; more make several.
SHEET_ROWS = 100_000


@contextmanager
def published(spark: SparkSession, path: str) -> Iterator[str]:
    """A place to write to; what is there at the end takes the place of ``path``, and after an error nothing has changed."""
    made, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    fs, staged = _file(spark, made)
    target, aside = _file(spark, path)[1], _file(spark, old)[1]
    try:
        yield made
        if fs.exists(target):
            fs.rename(target, aside)
        if not fs.rename(staged, target):
            raise OSError(f"{made} could not become {path}")
    finally:
        fs.delete(staged, True)
        fs.delete(aside, True)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    with published(df.sparkSession, path) as at:
        df.write.partitionBy(*partition_by).parquet(at)


def read_csv(spark: SparkSession, path: str | Sequence[str], required: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path if isinstance(path, str) else list(path))
    return require_columns(df, required, f"CSV {path}")


def read_sheets(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rating sheets as one; an item in two sheets raises."""
    out = None
    for p in paths:
        sheet = read_csv(spark, p, ["item_id", "rating"])
        out = sheet if out is None else out.unionByName(sheet, allowMissingColumns=True)
    return assert_unique(out, ["item_id"], "rating sheets")


def write_csv(df: DataFrame, path: str) -> None:
    """Files with a header: one where the sheet is small, else as many as the frame has partitions."""
    few = df.limit(SHEET_ROWS + 1).count() <= SHEET_ROWS
    with published(df.sparkSession, path) as at:
        (df.coalesce(1) if few else df).write.option("header", True).option("escape", '"').csv(at)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_outputs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Runner outputs: malformed lines dropped, error rows dropped, model tag from the file name where the row has none."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    df = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("_file", F.input_file_name())
    tag = F.regexp_extract("_file", r"([^/]+?)(?:_shard\d+)?\.jsonl?$", 1)
    kept = df.where(F.col("_bad").isNull() & ~F.coalesce(F.col("output_message"), F.lit("")).startswith("__ERROR__"))
    return kept.withColumn("model", F.coalesce("model", tag)).drop("_bad", "_file")


def write_shards(df: DataFrame, path: str, shards: int, order: Sequence[str]) -> None:
    """Contiguous shards of a total order as JSON lines under shard=k, numbered without one task for all rows."""
    n = df.count()
    ranked = numbered(df, list(order), "_id")
    with published(df.sparkSession, path) as at:
        ranked.withColumn("shard", F.expr(f"cast((_id - 1) * {shards} div {max(1, n)} as int)")).drop("_id").write.partitionBy("shard").json(at)


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    """A path and its file system, whichever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None where there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, text: str, path: str) -> None:
    fs, p = _file(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file, replaced as a whole."""
    with published(spark, path) as at:
        _create(spark, text, at)


def create_text(spark: SparkSession, text: str, path: str) -> None:
    """A new small file that appears in one rename, complete; one that is there already raises."""
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
    _create(spark, text, hidden)
    fs, p = _file(spark, hidden)
    if not fs.rename(p, _file(spark, path)[1]):
        fs.delete(p, False)
        raise FileExistsError(path)


def read_texts(spark: SparkSession, folder: str) -> dict[str, str]:
    """The small files of a folder by name, in the order of their names; hidden ones are not there yet."""
    fs, p = _file(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    return {n: read_text(spark, f"{folder}/{n}") or "" for n in names if not n.startswith(".")}


def canonical_sha256(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def freeze_probes(spark: SparkSession, items: list[dict], path: str) -> str:
    """Write a probe set as JSON and return the hash of its canonical form."""
    write_text(spark, json.dumps(items, indent=1, ensure_ascii=False), path)
    return canonical_sha256(items)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    shape = "message_id string, category string, source_category string, intended_text string, drift_type string, dangerous_variant string"
    return spark.read.schema(shape).option("multiLine", True).json(path)


def _plain(x: object) -> object:
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, (set, frozenset)):
        return sorted(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    raise TypeError(f"{type(x)} has no JSON form")


def write_digest(spark: SparkSession, blocks: dict[str, object], path: str) -> str:
    """Named result blocks (frames or plain values) as one JSON file; frames are results of a few rows."""
    out = {k: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in blocks.items()}
    text = json.dumps(out, default=_plain, indent=1, sort_keys=True)
    write_text(spark, text, path)
    return hashlib.sha256(text.encode()).hexdigest()


def rebuild_block(spark: SparkSession, path: str, name: str, made_from: str, fn: Callable[[DataFrame], DataFrame]) -> list[dict]:
    """Rebuild one block of a digest from the rows that another block stores; the other blocks stay as they are."""
    digest = json.loads(read_text(spark, path) or "{}")
    stored = spark.createDataFrame([tuple(r.values()) for r in digest[made_from]], list(digest[made_from][0]))
    digest[name] = [r.asDict(recursive=True) for r in fn(stored).collect()]
    write_text(spark, json.dumps(digest, default=_plain, indent=1, sort_keys=True), path)
    return digest[name]


def claims_missing(spark: SparkSession, digest: str, wanted: dict[str, str], paths: Sequence[str], forbidden: Sequence[str] = ()) -> list[tuple[str, str]]:
    """What texts fail to say: (claim, expected text) for digest values that occur in none of them as formatted, and forbidden words that do.

    ``wanted``: dotted paths into the digest, each with its format.
    """
    said = "\n".join(read_text(spark, p) or "" for p in paths)
    tree = json.loads(read_text(spark, digest) or "{}")
    out = []
    for key, form in wanted.items():
        value: object = tree
        for part in key.split("."):
            value = value[int(part)] if isinstance(value, list) else value[part]
        text = form.format(value)
        if text not in said:
            out.append((key, text))
    return out + [("forbidden", w) for w in forbidden if w in said]


def file_sha256(spark: SparkSession, path: str) -> str:
    """Hash of a file's bytes, streamed."""
    fs, p = _file(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def run_facts(spark: SparkSession) -> dict[str, object]:
    """What a run was made with: versions, application, master and time."""
    versions = {"spark": spark.version, "python": platform.python_version(), "numpy": np.__version__, "pyarrow": pyarrow.__version__}
    context = spark.sparkContext
    return {"versions": versions, "application": context.applicationId, "master": context.master, "at": datetime.datetime.now(datetime.UTC).isoformat()}


def log_provenance(spark: SparkSession, path: str, name: str, entry: dict) -> None:
    """Add an entry to a log: a file of its own in the folder ``path``, so writers at the same time lose nothing."""
    line = {"name": name, "entry": entry}
    create_text(spark, json.dumps(line, sort_keys=True, default=_plain), f"{path.rstrip('/')}/{time.time_ns():020}-{uuid.uuid4().hex}.json")


def read_provenance(spark: SparkSession, path: str) -> dict[str, dict]:
    """The log's entries by name, later ones merged over earlier ones."""
    log: dict[str, dict] = {}
    for text in read_texts(spark, path.rstrip("/")).values():
        line = json.loads(text)
        log[line["name"]] = {**log.get(line["name"], {}), **line["entry"]}
    return log


def write_matrix(spark: SparkSession, matrix: np.ndarray, alphabet: str, path: str) -> None:
    """A confusion matrix as a long Parquet table."""
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(alphabet) for j, b in enumerate(alphabet) if matrix[i, j]]
    write_parquet(spark.createDataFrame(rows, "intended string, selected string, p double").coalesce(1), path)


def read_matrix(spark: SparkSession, path: str, alphabet: str) -> np.ndarray:
    """The matrix that :func:`write_matrix` wrote."""
    m = np.zeros((len(alphabet), len(alphabet)))
    for r in spark.read.parquet(path).collect():
        m[alphabet.index(r["intended"]), alphabet.index(r["selected"])] = r["p"]
    return m


def for_rating(outputs: DataFrame) -> DataFrame:
    """Second-layout outputs under the names of the first: renamed and derived columns, confidence as a share."""
    need = ["message_id", "model", "corpus", "cer_target", "intended_text", "output_message", "confidence"]
    t = require_columns(outputs, need, "outputs")
    return t.select(F.concat_ws("|", "model", "message_id", F.col("cer_target").cast("string")).alias("item_key"), F.col("model").alias("source_model"), "corpus", F.col("cer_target").alias("cer"), F.col("intended_text").alias("reference"), F.col("output_message").alias("candidate"), (F.col("confidence") / 100).alias("confidence_share"))
