"""What the training-data operators share: the folder all executors see, written
stages, Arrow helpers and sorted hash arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..plans.ship import ship

#: Multipliers of the 64-bit mixing functions; any odd constants with well spread bits do.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset (tests, notebooks) a temporary folder is taken in local mode
    and one below the warehouse otherwise, and set for the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        local = spark.sparkContext.master.startswith("local")
        path = tempfile.mkdtemp(prefix="tickloom-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_stages"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, outlives executors."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_alone(df: DataFrame, name: str) -> DataFrame:
    """written(); the shuffle files of df's plan are deleted as soon as it is done."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fresh(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df has it (Spark does not tell cases apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(df: DataFrame) -> None:
    """Delete a stage that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stages/" in folder:
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about most_bytes of text (a longer text comes alone)."""
    for batch in batches:
        at, size = 0, 0
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > most_bytes:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += int(n)
        if at < batch.num_rows:
            yield batch.slice(at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix of an unsigned array."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX_B
    x ^= x >> np.uint64(29)
    x *= MIX_A
    x ^= x >> np.uint64(32)
    return x


class HashArray:
    """Sorted 64-bit hashes with an index on their leading bits: whole arrays are
    looked up by a table read and a few steps to the right."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(1, int(np.ceil(np.log2(max(2, len(hashes))))))
        self.shift = np.uint64(64 - self.bits)
        self.start = np.searchsorted(hashes, np.arange(1 << self.bits, dtype=np.uint64) << self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Positions of the hashes, -1 where absent."""
        if not len(self.hashes):
            return np.full(len(wanted), -1, np.int64)
        last = len(self.hashes) - 1
        at = np.minimum(self.start[(wanted >> self.shift).astype(np.int64)], last)
        open_ = np.flatnonzero(self.hashes[at] < wanted)
        while len(open_):
            at[open_] += 1
            open_ = open_[at[open_] <= last]
            open_ = open_[self.hashes[at[open_]] < wanted[open_]]
        found = at <= last
        found[found] = self.hashes[at[found]] == wanted[found]
        at[~found] = -1
        return at


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of the links a-b: each node with the root of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
