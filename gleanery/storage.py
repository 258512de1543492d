"""Intermediate tables in the folder that the cluster shares.

A written table cuts the lineage, survives a lost executor and can be dropped as soon as nothing reads it.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (tests) gets a folder of its own; a cluster gets an error, because a
    machine-local folder would not be seen by the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


class Tables:
    """Tables written by one run of an operator, each under a fresh path."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """Write ``df`` as Parquet and return the table that reads it."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._gleanery_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        self._delete(t._gleanery_path for t in tables)

    def drop_but(self, *tables: DataFrame) -> None:
        """Delete all tables of this run but these, which the result still reads."""
        needed = {t._gleanery_path for t in tables}
        self._delete(path for path in (f"{self.root}/{i}" for i in range(1, self.n + 1)) if path not in needed)

    def _delete(self, paths: Iterable[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


class Versions:
    """A folder of Parquet parts, and numbered states that say which of them count.

    A state is a small JSON file. Writers put parts under fresh names first and then create the next state; readers take
    the newest whole state, so they see all of a change or nothing. A crash leaves parts that no state names, or a state
    that is cut short and ignored. A number is created once: of two writers with the same state, one gets an error.
    """

    #: States whose parts are kept, so that a reader that has just taken one can finish.
    KEPT = 2

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _load(self, name: str) -> dict | None:
        stream = self.fs.open(self._path(f"states/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # cut short
            return None
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The number of the newest state, whole or not, and the newest whole one; (0, {}) at first."""
        names = [n for n in self._names("states") if n.endswith(".json")]
        for name in reversed(names):
            state = self._load(name)
            if state is not None:
                return int(names[-1].split(".")[0]), state
        return (int(names[-1].split(".")[0]) if names else 0), {}

    def put(self, df: DataFrame, *partition: str) -> str:
        """Write a part and return its name."""
        name = uuid.uuid4().hex
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition) if partition else writer).parquet(f"{self.path}/parts/{name}")
        return name

    def get(self, names: list[str], schema: T.StructType | str) -> DataFrame:
        """The rows of parts, or of folders inside them."""
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/parts/{n}" for n in names))

    def commit(self, after: int, state: dict) -> None:
        """Make ``state`` the one after number ``after``; an error if there is one already."""
        out = self.fs.create(self._path(f"states/{after + 1:012d}.json"), False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._clean()

    def _clean(self) -> None:
        """Delete old states, and parts that none of those kept names."""
        names = [n for n in self._names("states") if n.endswith(".json")]
        for name in names[: -self.KEPT]:
            self.fs.delete(self._path(f"states/{name}"), False)
        states = " ".join(json.dumps(self._load(n) or {}) for n in names[-self.KEPT :])
        for part in self._names("parts"):
            if part not in states:
                self.fs.delete(self._path(f"parts/{part}"), True)


class Buckets:
    """A table in buckets by the hash of a key, one part folder for each; a change rewrites only the buckets it touches.

    ``state`` maps a bucket's number to its folder; it is part of a state of ``versions``, so several tables can change
    together.
    """

    def __init__(self, versions: Versions, schema: T.StructType | str, key: str = "key", buckets: int = 64):
        self.versions, self.key, self.n = versions, key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def read(self, state: dict[str, str], buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = state if buckets is None else [str(b) for b in buckets if str(b) in state]
        return self.versions.get([state[b] for b in wanted], self.schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of ``keys``: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def rewrite(self, state: dict[str, str], gone: DataFrame, new: DataFrame) -> dict[str, str]:
        """The state after rows with the keys of ``gone`` went and ``new`` came; their buckets are written anew."""
        touched = self.touched(gone.select(self.key).union(new.select(self.key)))
        if not touched:
            return state
        kept = self.read(state, touched).join(gone.select(self.key).distinct(), self.key, "left_anti")
        rows = kept.select(*self.schema.names).unionByName(new.select(*self.schema.names)).withColumn("__bucket", self.bucket())
        part = self.versions.put(rows.repartition(min(len(touched), self.n), "__bucket"), "__bucket")
        there = {n.split("=")[1] for n in self.versions._names(f"parts/{part}") if n.startswith("__bucket=")}
        left = {b: f for b, f in state.items() if int(b) not in touched}
        return left | {b: f"{part}/__bucket={b}" for b in there}
