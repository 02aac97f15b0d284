"""What the operators of this subpackage share: table access, shared storage and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="hoistway-")
        shared_dir.own = at
    return at.rstrip("/")


_OPEN: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within this block, but those to be kept, are removed at its end: nothing lazy that reads them may leave it."""
    _OPEN.append([])
    try:
        yield
    finally:
        for at in _OPEN.pop():
            _remove(spark, at)


def stored(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: cuts lineage so that lost executors cost no recomputation."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/hoistway-{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if _OPEN and not keep:
        _OPEN[-1].append(at)
    return spark.read.schema(df.schema).parquet(at)


def _remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Removes a table that stored() wrote, when nothing reads it any more."""
    spark = df.sparkSession
    for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _remove(spark, f)


class Scratch:
    """Stored tables of one operator, removed together once its last one is written."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        self.made.append(stored(df, what))
        return self.made[-1]

    def drop(self) -> None:
        for df in self.made:
            drop_stored(df)
        self.made = []


#: What a Python worker has built and keeps for its next tasks: models and tables of one operator at a time.
_BUILT: dict[str, object] = {}


def give_back() -> None:
    """Returns freed memory to the system where the C library can, so that a worker's later tasks don't carry the peak of an earlier one."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keep_only(kind: str) -> None:
    """Drops what other operators have built in this worker."""
    if other := [k for k in _BUILT if k.partition(":")[0] != kind]:
        for k in other:
            del _BUILT[k]
        give_back()


def built(kind: str, key: str, make: Callable[[], object], most: int = 1):
    """What make() gives, once for each Python worker and key; ``most`` things of a kind are kept."""
    name = f"{kind}:{key}"
    if name not in _BUILT:
        keep_only(kind)
        while len(_BUILT) >= most:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[name] = make()
    return _BUILT[name]


def map_columns(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, rows: int = 0, kind: str = "") -> DataFrame:
    """mapInArrow over column lists: fn gets each input column of a batch as a pyarrow array and returns columns by name.

    ``rows`` above 0 cuts batches into slices of that many rows, which bounds a task's memory for long texts. ``kind`` names what fn keeps by built().
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(kind)
        for whole in batches:
            step = rows or max(1, whole.num_rows)
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                out = fn(*batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
