"""A keyed table whose batches are staged, then committed at once: repeated and killed batches leave one result.

Rows live in buckets of their keys' hash. A batch writes the new content of the buckets that it touches to a folder of its
own; then one small file with the batch's number names, for every bucket, the folders that hold it. Readers follow the
latest such file, so they see all of a batch or nothing. A batch whose file is there is not done again; what a killed
batch staged is never read, and `vacuum` deletes it. Folders and files go through Hadoop's file systems, so that the table
may lie wherever Spark writes. One writer at a time, as a stream's batches are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CommittedTable:
    """Rows of `schema`, keyed by `keys`, below `path`."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def commits(self) -> list[int]:
        """The numbers of the batches that are committed, in order of their commits."""
        return [self._read(n)["batch"] for n in self._files()]

    def _files(self) -> list[str]:
        return [n for n in self._names("_commits") if n.endswith(".json")]

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"_commits/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _state(self) -> dict:
        files = self._files()
        return self._read(files[-1]) if files else {"no": -1, "batch": None, "done": [], "folders": {}}

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of the last commit, of these buckets or all."""
        state = self._state()["folders"]
        return self._rows(sorted({f for b, own in state.items() if buckets is None or int(b) in buckets for f in own}))

    def is_committed(self, batch: int) -> bool:
        return batch in self._state()["done"]

    def _staged(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows by bucket into a folder of this attempt; bucket -> folder."""
        folder = f"data/{uuid.uuid4()}"
        rows.select([f.name for f in self.schema]).withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}

    def _commit(self, batch: int, state: dict, folders: dict[str, list[str]]) -> None:
        """The commit is a rename, which a file system does wholly or not."""
        number = state["no"] + 1
        text = json.dumps({"no": number, "batch": batch, "done": [*state["done"][-999:], batch], "folders": folders})
        draft = self._path(f"_commits/{uuid.uuid4()}.draft")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, self._path(f"_commits/{number:012d}.json")):
            raise OSError(f"batch {batch} could not be committed to {self.path}")

    def upsert(self, rows: DataFrame, batch: int, deleted: DataFrame | None = None) -> bool:
        """Rows replace those of their keys, and the keys in `deleted` go; False if the batch was committed before.

        Keys of `rows` are unique. Only buckets of touched keys are read and written; their numbers, `buckets` at most, are
        what the driver gathers.
        """
        state = self._state()
        if batch in state["done"]:
            return False
        keys = rows.select(*self.keys)
        if deleted is not None:
            keys = keys.unionByName(deleted.select(*self.keys))
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        old = self._rows(sorted({f for b in touched for f in state["folders"].get(str(b), [])}))
        # A folder may hold rows of one bucket only, so that what is read here is what the new folders replace.
        staged = self._staged(old.join(keys.distinct(), self.keys, "left_anti").unionByName(rows.select(old.columns)))
        folders = {b: own for b, own in state["folders"].items() if int(b) not in touched}
        self._commit(batch, state, folders | {b: [f] for b, f in staged.items()})
        return True

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Adds rows without a look at those there; False if the batch was committed before."""
        state = self._state()
        if batch in state["done"]:
            return False
        folders = {b: list(own) for b, own in state["folders"].items()}
        for b, f in self._staged(rows).items():
            folders.setdefault(b, []).append(f)
        self._commit(batch, state, folders)
        return True

    def compact(self) -> None:
        """One folder per bucket again, after many appends."""
        state = self._state()
        many = sorted(int(b) for b, own in state["folders"].items() if len(own) > 1)
        if many:
            staged = self._staged(self.read(many))
            self._commit(state["batch"], state | {"done": [b for b in state["done"] if b != state["batch"]]}, state["folders"] | {b: [f] for b, f in staged.items()})

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last `keep` commits names, and drafts; how many folders went."""
        used = {f for n in self._files()[-keep:] for own in self._read(n)["folders"].values() for f in own}
        gone = 0
        for folder in self._names("data"):
            parts = [f"data/{folder}/{n}" for n in self._names(f"data/{folder}") if n.startswith("_bucket=")]
            stale = [p for p in parts if p not in used]
            for p in [f"data/{folder}"] if len(stale) == len(parts) else stale:
                self._fs.delete(self._path(p), True)
                gone += 1
        for name in self._names("_commits"):
            if name.endswith(".draft"):
                self._fs.delete(self._path(f"_commits/{name}"), True)
        return gone
