"""Other sources and sinks: saved models, matrices, offsets, CSV, ARFF, packed runs, content hashes."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import MalformedModel, Unsupported
from ..model import NODE_SCHEMA, Forest, Node

MODEL_VERSION = 1
PREDICATE_SCHEMA = "predicate INT, feature INT, categorical BOOLEAN, threshold DOUBLE, categories ARRAY<BIGINT>, default_left BOOLEAN, op STRING"


def save_model(spark: SparkSession, forest: Forest, path: str) -> None:
    """Nodes, predicates and header as Parquet, with version and content hash."""
    spark.createDataFrame(forest.node_rows(), NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(k, p[0], p[1], p[2], list(p[3]), p[4], p[5]) for k, p in enumerate(forest.predicates)], PREDICATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/predicates")
    header = [(MODEL_VERSION, json.dumps(forest.header()), forest.fingerprint())]
    spark.createDataFrame(header, "version INT, header STRING, sha256 STRING").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def load_model(spark: SparkSession, path: str) -> Forest:
    """A saved model; topology and hash are checked again. The rows of one model fit the driver (LoadOptions)."""
    version, text, digest = spark.read.parquet(f"{path}/header").first()
    if version != MODEL_VERSION:
        raise Unsupported(f"saved version {version}")
    header, trees = json.loads(text), {}
    for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toLocalIterator():
        split = {} if r.is_leaf else {
            "op": r.op, "feature": r.feature, "threshold": float("nan") if r.threshold is None else r.threshold,
            "categories": tuple(r.categories or ()), "default_left": r.default_left, "left": r.left_id, "right": r.right_id}
        trees.setdefault(r.tree, []).append(Node(**split, value=r.leaf_value if r.is_leaf else 0.0, weight=r.weight))
    forest = Forest(tuple(tuple(trees[k]) for k in sorted(trees)), header["n_features"], header["single"], header["base_score"],
                    header["averaged"], header["link"], header["alpha"])
    if forest.fingerprint() != digest:
        raise MalformedModel("the saved model does not match its hash")
    if spark.read.parquet(f"{path}/predicates").count() != len(forest.predicates):
        raise MalformedModel("the saved predicates are not the model's")
    return forest


def write_matrix(x: np.ndarray) -> bytes:
    """u64 rows, u64 columns, then row-major float64, little-endian."""
    return struct.pack("<QQ", *x.shape) + np.ascontiguousarray(x, "<f8").tobytes()


def read_matrix(raw: bytes) -> np.ndarray:
    if len(raw) < 16:
        raise MalformedModel("no matrix header")
    rows, columns = struct.unpack_from("<QQ", raw)
    if len(raw) != 16 + 8 * rows * columns:
        raise MalformedModel("matrix size")
    return np.frombuffer(raw, "<f8", offset=16).reshape(rows, columns)


def write_offsets(offsets: Sequence[int]) -> bytes:
    return struct.pack("<Q", len(offsets) - 1) + np.array(offsets, "<u8").tobytes()


def read_offsets(raw: bytes) -> list[int]:
    """u64 groups, then one more u64 offsets: from 0, strictly rising."""
    n = struct.unpack_from("<Q", raw)[0] if len(raw) >= 8 else -1
    if len(raw) != 8 + 8 * (n + 1):
        raise MalformedModel("offsets size")
    found = np.frombuffer(raw, "<u8", offset=8).tolist()
    if found[0] != 0 or any(b <= a for a, b in zip(found, found[1:], strict=False)):
        raise MalformedModel("offsets do not rise from 0")
    return found


def write_npy(x: np.ndarray) -> bytes:
    """NumPy's own format, without pickled objects."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(x), allow_pickle=False)
    return out.getvalue()


def read_npy(raw: bytes) -> np.ndarray:
    try:
        return np.load(io.BytesIO(raw), allow_pickle=False)
    except (ValueError, EOFError) as e:
        raise MalformedModel(str(e)) from e


def matrix_frame(spark: SparkSession, path: str) -> DataFrame:
    """row_no and features ARRAY<DOUBLE> of every matrix file under path, one task a file."""
    def rows(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                x = read_matrix(content)
                yield pd.DataFrame({"path": name, "row_no": np.arange(len(x)), "features": list(x)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "path STRING, row_no BIGINT, features ARRAY<DOUBLE>")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, null: str = "NULL") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", null).csv(path)


def read_arff(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Numeric ARFF: lines that are neither declarations (`@`) nor comments (`%`); '?' is null. Files are split by lines."""
    line = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("line"))
    cells = F.split("line", ",")
    kept = line.filter((F.col("line") != "") & ~F.col("line").rlike("^[%@]"))
    return kept.select(*[_cell(cells[k]).alias(c) for k, c in enumerate(columns)])


def _cell(cell: Column) -> Column:
    text = F.trim(cell)
    return F.when(text != "?", text).cast("double")


def pack(parts: Sequence[DataFrame], schema: StructType, path: str) -> None:
    """Parts under one schema as one table; ANSI casts fail on loss of range. Reads back and compares."""
    typed = [p.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]) for p in parts]
    whole = typed[0]
    for part in typed[1:]:
        whole = whole.unionByName(part)
    whole.write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = whole.sparkSession.read.parquet(path)
    if not whole.exceptAll(back).isEmpty() or not back.exceptAll(whole).isEmpty():
        raise MalformedModel(f"{path} reads back differently")


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and a hash per column that ignores row order: sums of two 32-bit halves of xxhash64."""
    halves = [F.sum(F.xxhash64(F.col(c)).bitwiseAND(0xFFFFFFFF)).alias(c) for c in df.columns]
    return df.agg(F.count("*").alias("n_rows"), *halves)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of every file under path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
