"""What iterative operators share: settings, materialised rounds, released caches, the scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import shutil
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

PREFIX = "weft."
NO_LOCAL = "no local checkpoints: state is written to the shared folder, which survives lost executors"


def setting(spark: SparkSession, name: str, default):
    """A session setting weft.<name>, in the type of its default."""
    value = spark.conf.get(PREFIX + name, None)
    if value is None:
        return default
    return value.lower() == "true" if isinstance(default, bool) else type(default)(value)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own if all tasks run on this machine; elsewhere each executor would
    write to its own disk, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share (master {master})")
        at = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at, True)
    return at.rstrip("/")


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Spark's own file system, whatever kind of store it is. Over a remote session
    there is no such access; the folder then stays."""
    if not hasattr(spark, "_jvm"):
        return
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def fitting(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of about `each` rows, as many as the session's shuffles have at most."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)))


@contextlib.contextmanager
def shuffled_to(spark: SparkSession, n: int):
    """Shuffles of the actions within go to n partitions, as cached tables of so many then need no other shuffle to be joined with."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def as_storage_level(value: StorageLevel | str) -> StorageLevel:
    if isinstance(value, StorageLevel):
        return value
    level = getattr(StorageLevel, value.upper(), None)
    if not isinstance(level, StorageLevel):
        raise ValueError(f"unknown storage level {value!r}")
    return level


#: Options of the call that is being made; operators read them where they make their Rounds.
CALL: contextvars.ContextVar = contextvars.ContextVar("weft call", default=None)


def tuned(method):
    """Adds the options that all iterative methods have; any other unknown argument stays an error.

    checkpoint_interval: every how many steps the state is written (1: each); between, it is cached. storage_level: of what is cached.
    use_local_checkpoints, broadcast_threshold: known for compatibility. State always goes to the shared folder, as executors can be lost, and adaptive
    execution decides about broadcasts; asking for something else gives a warning.
    """

    @functools.wraps(method)
    def run(*args, checkpoint_interval: int | None = None, storage_level: StorageLevel | str | None = None, use_local_checkpoints: bool = False, broadcast_threshold: int | None = None, **options):
        if checkpoint_interval is not None and checkpoint_interval < 1:
            raise ValueError("checkpoint_interval must be positive")
        if use_local_checkpoints:
            warnings.warn(NO_LOCAL, stacklevel=2)
        if broadcast_threshold not in (None, -1):
            warnings.warn("broadcast_threshold has no effect: adaptive execution decides", stacklevel=2)
        token = CALL.set((checkpoint_interval, None if storage_level is None else as_storage_level(storage_level)))
        try:
            return method(*args, **options)
        finally:
            CALL.reset(token)

    return run


class Rounds:
    """Materialises the state of each round as a table in the shared folder.

    The written table ends the lineage and survives the loss of any executor. Tables that later rounds have superseded are
    deleted as the loop goes. Settings weft.checkpointInterval and weft.intermediateStorageLevel stand in for options that a call doesn't give,
    and before them the same under weft.<scope>.
    """

    def __init__(self, spark: SparkSession, name: str, scope: str = ""):
        self.spark, self.home, self.k = spark, f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}", 0
        interval, level = CALL.get() or (None, None)
        known = lambda name, default: setting(spark, f"{scope}.{name}", setting(spark, name, default)) if scope else setting(spark, name, default)
        self.interval = interval or known("checkpointInterval", 1)
        self.level = level or as_storage_level(known("intermediateStorageLevel", "MEMORY_AND_DISK"))
        if self.interval < 1:
            raise ValueError("weft.checkpointInterval must be positive")
        if setting(spark, "useLocalCheckpoints", False):
            warnings.warn(NO_LOCAL, stacklevel=3)
        self.cached: list[DataFrame] = []
        self.made: list[str | DataFrame] = []
        self.closing = False

    def cut(self, df: DataFrame, name: str = "") -> DataFrame:
        """A step's result: written, or cached if it isn't the interval's turn."""
        self.k += 1
        if self.k % self.interval:
            self.made.append(df.persist(self.level))
            return df
        return self.write(df, name)

    def write(self, df: DataFrame, name: str = "") -> DataFrame:
        path = f"{self.home}/{self.k}{name}"
        df.write.parquet(path)
        self.made.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def collector(self, name: str) -> Collector:
        return Collector(self, name)

    def forget(self, keep: int) -> None:
        """Delete all but the last `keep` tables. A cached one may rest on older ones, so with an interval nothing goes before the end."""
        while len(self.made) > keep and (self.interval == 1 or self.closing):
            old = self.made.pop(0)
            if isinstance(old, str):
                remove_table(self.spark, old)
            else:
                old.unpersist()

    def cache(self, df: DataFrame) -> DataFrame:
        """Cached until close(); recomputed from its source where an executor is lost."""
        self.cached.append(df.persist(self.level))
        return df

    def close(self, result: DataFrame, keep: int = 1) -> DataFrame:
        """The result, materialised; nothing of the loop stays cached, and no other table is left."""
        self.k += 1
        done = self.write(result, "-result")
        for df in self.cached:
            df.unpersist()
        self.closing = True
        self.forget(keep)
        return done


class Collector:
    """A table that grows by a part a round and is read as one: the plan stays the same size however many rounds there are."""

    def __init__(self, rounds: Rounds, name: str):
        self.rounds, self.path, self.schema, self.k = rounds, f"{rounds.home}/{rounds.k}{name}", None, 0
        rounds.k += 1

    def add(self, df: DataFrame) -> DataFrame:
        """Write the next part, and read that part back."""
        self.schema = self.schema or df.schema
        at = f"{self.path}/{self.k}"
        self.k += 1
        df.write.parquet(at)
        return self.rounds.spark.read.schema(self.schema).parquet(at)

    def all(self) -> DataFrame:
        paths = [f"{self.path}/{k}" for k in range(self.k)]
        return self.rounds.spark.read.schema(self.schema).parquet(*paths)

    def remove(self) -> None:
        remove_table(self.rounds.spark, self.path)
