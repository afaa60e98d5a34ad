"""Reading, Arrow mapping and lineage cutting shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that one step of an Arrow map turns into Python objects at once.
SLICE_ROWS = 512


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this folder's code to the executors, once a Spark application, so
    that it needn't be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="veracell-code-")) / "veracell_llm.zip"
    with zipfile.ZipFile(target, "w") as z:
        z.write(here.parent / "__init__.py", "veracell/__init__.py")
        for f in sorted(here.glob("*.py")):
            z.write(f, f"veracell/{here.name}/{f.name}")
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a file that can't be split (one row group)
    would leave most of them idle; else ``df`` as it is. At most a quarter of the
    cores' input splits is ever shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 4 <= cores else df


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator reads, under fixed names, so that any
    further columns of the input, whatever they are called, cannot clash."""
    ship(docs.sparkSession)
    return spread(docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"),
                              F.col(quoted(text_col)).cast("string").alias("text")))


def arrow_map(df: DataFrame, schema: str, build: Callable[[], Callable], finish: bool = False) -> DataFrame:
    """Maps slices of column lists to a dict of columns.

    ``build`` runs once in each task and returns ``work(*columns)``; with
    ``finish`` the object's ``close()`` may return a last dict of columns.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        work = build()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = work(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns])
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
        if finish:
            out = work.close()
            if out is not None:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def map_text(df: DataFrame, text_col: str, change: Callable) -> DataFrame:
    """All columns of ``df``, whatever their names, with the texts that
    ``change(list of texts)`` gives for those of a batch."""
    ship(df.sparkSession)
    names = df.columns
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])
    at, schema = names.index(text_col), plain.schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array(change(batch.column(at)), arrow.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return plain.mapInArrow(run, schema).toDF(*names)


def clear_of(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """For each of the ascending spans ``found`` whether it meets none of
    ``taken`` (ascending starts): one pass over both."""
    out, at, reach = [], 0, -1
    for a, b in found:
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        out.append(reach <= a)
    return out


def opened(uri: str, mode: str):
    """A file of any store that Arrow knows, to read, or with "w" to write."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    if mode == "w":
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(at, compression=None)
    return store.open_input_file(at)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (tests, local runs)
    a temporary one is set; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="veracell-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known.rstrip("/")


class Scratch:
    """The tables that one operator writes to the shared folder.

    ``keep`` cuts lineage, so a lost executor repeats one step; ``drop`` removes
    what later steps don't read. What a returned frame reads stays until the
    application ends, when the file system removes the folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._files(self.folder)[0].deleteOnExit(self._files(self.folder)[1])

    def _files(self, path: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(context._jsc.hadoopConfiguration()), at

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.parquet(f"{self.folder}/{name}")
        free_shuffles(self.spark)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            files, at = self._files(f"{self.folder}/{name}")
            files.delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """One frame as a table of its own in the shared folder."""
    return Scratch(df.sparkSession, label).keep(df, "rows")


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished steps: its cleaner works only
    when the JVM collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
