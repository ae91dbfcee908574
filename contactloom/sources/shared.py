"""Tables and checkpoints in the shared folder that the cluster names."""

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own. On a cluster no
    folder is guessed, since executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(
                f"spark.checkpoint.dir is not set: master {master} needs a folder that all executors share"
            )
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="contactloom-")
        folder = _own_folders[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting to drop an execution's shuffle files when it has ended.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet and read it back, so that several readers compute it once.

    The table outlives lost executors; the caller's clean-up of the shared folder removes it. Once
    it is written, the shuffles that made it are of no more use and their files go, so a job of
    many tables needs disk for one of them at a time.
    """
    return _written(df, new_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    try:
        spark.conf.set(_SHUFFLE_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: A stage of a job: its name, and what makes its table if that is not there yet.
Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]


def kept_once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage of a run that starts from its beginning: a new table every time."""
    return shared_table(make(), name)


def input_mark(*inputs: DataFrame | str) -> str:
    """A name for inputs: the same rows, in whatever order, and the same texts give the same one.

    One aggregate for each table, over the columns it is given with; leave out those that need not
    be told apart, as ``html`` beside a ``page_id``.
    """
    mark = hashlib.sha256()
    for given in inputs:
        if isinstance(given, DataFrame):
            row = F.xxhash64(*[F.col(f"`{c}`") for c in given.columns])
            seen = given.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
            given = f"{given.schema.simpleString()} {tuple(seen)}"
        mark.update(f"{len(given)}:{given}".encode())
    return mark.hexdigest()[:24]


def resumable(spark: SparkSession, mark: str) -> Keep:
    """Stages that a later run with the same ``mark`` finds again.

    A finished stage is a row of the manifest, one small table a stage in the shared folder, written
    when the stage's own table is whole. A run that was stopped inside a stage leaves a table that no
    manifest names, which is never read.
    """
    folder = f"{shared_folder(spark)}/stages-{mark}"

    def keep(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        manifest = f"{folder}/{name}"
        try:
            done = spark.read.schema("path string, fields string").parquet(manifest).first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            done = None
        if done is not None:
            return spark.read.schema(done["fields"]).parquet(done["path"])
        path = new_path(spark, name)
        made = _written(make(), path)
        row = spark.createDataFrame([(path, _fields(made))], "path string, fields string")
        row.coalesce(1).write.mode("overwrite").parquet(manifest)
        return made

    return keep


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
