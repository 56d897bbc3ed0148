"""Access to the session: tables, the shared folder, and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()
_made: list[str] = []
_tables: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable by the session's Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        with tempfile.NamedTemporaryFile(prefix="graphweft-", suffix=".zip", delete=False) as file, zipfile.ZipFile(file, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(file.name)
        _shipped.add(app)
    return spark


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``, pruned to ``columns`` where any are given."""
    df = ship(spark).read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.  A local one is set only where the session names none and runs on one machine, as in
    tests; a cluster without a shared folder is refused."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='graphweft-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from now on: the lineage ends here, and a lost executor
    costs no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; ``clean`` deletes it."""
    path = f"{shared_folder(spark).rstrip('/')}/graphweft/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def keep(spark: SparkSession, name: str) -> None:
    """Remembers a table for ``clean``."""
    _tables.append(name)


def clean(spark: SparkSession) -> None:
    """Drops the tables and deletes the files that operators of this session made, once their results are no longer needed."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _made:
        discard(spark, _made[-1])


def discard(spark: SparkSession, made: str) -> None:
    """Deletes what was made at a path that ``fresh_path`` gave."""
    _made.remove(made)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
