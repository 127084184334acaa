"""Helpers shared by the training-data operators.

Nothing here collects a table: tables that are read more than once are written as Parquet below the
folder named by ``spark.checkpoint.dir`` (which driver and executors share) and read back, which also
cuts the lineage, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python workers get, so that memory doesn't follow document length."""
    for key, value in (("maxRecordsPerBatch", "2000"), ("maxBytesPerBatch", str(16 << 20))):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only in local mode, where driver and executors are one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexspan/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexspan_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote for these; only once nothing lazy reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._lexspan_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fetch(df: DataFrame):
    """The rows of a small result as a pandas frame, by Arrow (Row objects would take ten times the memory)."""
    return df.toArrow().to_pandas()


def trim_memory() -> None:
    """Give freed memory back to the system; Python workers live on between tasks."""
    import ctypes
    import gc

    gc.collect()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def worker_cache(name: str) -> dict:
    """A dict of that name which tasks of a Python worker that follow one another share; another operator's is emptied first."""
    import sys
    import types

    held = sys.modules.setdefault("_lexspan_worker", types.ModuleType("_lexspan_worker"))
    for key, other in held.__dict__.items():
        if isinstance(other, dict) and key != name:
            other.clear()
    return held.__dict__.setdefault(name, {})


def least_count(counts: DataFrame, most: int, n: str = "n", entries: Column | None = None) -> int:
    """The smallest t such that rows with n >= t have ``most`` entries (rows, unless given) or fewer in all.

    Found from a histogram of at most a few thousand classes (exact up to 255, then steps of 2 %), so no sort and no row
    goes to the driver; what lies in one class stays or goes together.
    """
    step = F.when(F.col(n) < 256, F.col(n)).otherwise(F.floor(256 * F.pow(F.lit(1.02), F.floor(F.log(1.02, F.col(n) / 256)))))
    classes = counts.groupBy(step.cast("long").alias("least")).agg((F.count("*") if entries is None else F.sum(entries)).alias("n")).orderBy(F.desc("least")).collect()
    upto = 0
    for r in classes:
        upto += r["n"]
        if upto > most:
            return r["least"] + 1 if r["least"] < 256 else int((r["least"] + 1) * 1.02) + 1
    return 0


def fold(column: str = "doc_id", modulus: int = 5):
    """crc32 of the decimal text of an id, modulo ``modulus`` (null ids: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; null stays None."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_text(df: DataFrame, start: Callable[[], Callable[[list[bytes | None]], dict]], schema: str, carry: list[str], text: str = "text") -> DataFrame:
    """Append columns computed from ``text`` by Python workers, batch by batch.

    ``start`` runs once in each task and returns the function from a list of texts to a dict of lists.
    ``schema`` is the DDL of the new columns; input columns of these names are replaced. ``carry`` names
    the columns that go through unchanged. One pass, no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    new = [f.name for f in fields]
    carry = [c for c in carry if c not in new]
    source = df.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias("__text"))
    out = StructType([source.schema[c] for c in carry] + list(fields))
    types = to_arrow_schema(StructType(list(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            made = work(utf8(batch.column(len(carry))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *[made[f.name].cast(f.type) if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in types]], names=[*carry, *new])
        del work
        trim_memory()

    return source.mapInArrow(run, out)


def pieces(words: list, most: int = 1 << 16) -> Iterator[list]:
    """Parts of a long list, so that work on one very long text needs bounded memory."""
    for i in range(0, len(words), most):
        yield words[i : i + most]


def union_min(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Connected components of n nodes by edges a-b: the smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if not (open_ := low != high).any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, as (node, root): root is the component's smallest node.

    ``edges`` has two long columns a and b; loops and repeats are harmless, nulls are ignored. Alternates
    large-star and small-star steps (Kiveris et al., SoCC 2014) until nothing changes: the number of rounds
    grows with the logarithm of the longest path. Minima are pre-aggregated before each shuffle, and the
    joins read two written tables, so that AQE can split the partition of a hub. Nodes without edges
    don't appear in the result.
    """

    def star(now: DataFrame, large: bool) -> DataFrame:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else now
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        if large:
            out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = now.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        done = materialize(out.filter("u <> v").distinct())
        discard(least)
        return done

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = mark(now)
    while seen[0]:
        for large in (True, False):
            before, now = now, star(now, large)
            discard(before)
        if (new := mark(now)) == seen:
            break
        seen = new
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
