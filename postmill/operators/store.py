"""A versioned store: rows by id in hash buckets, changed by copying the buckets that a change touches.

Parquet tables have no MERGE. A state of the store is a manifest: for each bucket, the folder that holds its rows. A commit writes new
folders for touched buckets only, then its manifest, complete under a name of its own, which is renamed to the next number: the commit takes place
if no other writer has that number. The loser reads the new state and computes its change again. Nothing is overwritten, so a crash at any
point leaves the current state as it is, and what it left behind is in no manifest.

A commit may have a name. Given again, at any later time, it is the same change and is not even computed. A name is known by a marker, which whoever commits next sets
for the commit before, so only the last commit can be without its own; markers stay when ``expire`` removes old folders.

Rows of a bucket are sorted by id, and files carry Bloom filters of ids and fingerprints: a lookup opens one bucket and skips row groups. Columns
are resolved at reading: those a file has not get their defaults, those no longer known are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.runtime import discard, sized, written
from postmill.schema import JOBS, conform

#: Bytes of input for each bucket, and the least number of them.
BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 16
#: Columns with Bloom filters beside the key.
FILTERED = ("fingerprint",)
#: Times that a change is computed before other writers are given the blame.
TRIES = 20

SKIPPED = "source string, url string, error string"


class Conflict(RuntimeError):
    """Other writers were first every time."""


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, schema: T.StructType = JOBS, key: str = "id"):
        """buckets: how many a whole write makes; by its size if not given. schema, key: of the rows, which are jobs if not said otherwise."""
        self.spark, self.path, self.buckets, self.schema, self.key = spark, path.rstrip("/"), buckets, schema, key

    # Files of the log, through Hadoop's file systems: they may lie in any store that Spark reads.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names("_log") if n.isdigit())

    def _manifest(self, number: int) -> dict:
        fs, p = self._fs(f"{self.path}/_log/{number:012d}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _mark(self, version: str) -> None:
        fs, p = self._fs(f"{self.path}/_marks/{quote(version, safe='')}")
        if not fs.exists(p):
            fs.create(p, True).close()

    def _point(self, number: int, manifest: dict) -> bool:
        """Whether this manifest became the state of that number: false where another writer has it."""
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs
        fs, draft = self._fs(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        target = hadoop.Path(f"{self.path}/_log/{number:012d}")
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def _bucket(self, n: int) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    # States.

    def history(self) -> list[tuple[int, str]]:
        """(number, version) of all that were ever current, in order."""
        return [(n, self._manifest(n)["version"]) for n in self._numbers()]

    def _state(self, version: str | None = None) -> tuple[int, dict] | None:
        numbers = self._numbers()
        if version is None:
            return (numbers[-1], self._manifest(numbers[-1])) if numbers else None
        for n in reversed(numbers):
            if (m := self._manifest(n))["version"] == version:
                return n, m
        raise KeyError(f"no version {version}")

    def version(self) -> str | None:
        state = self._state()
        return state[1]["version"] if state else None

    def has(self, name: str) -> bool:
        """Whether a change of this name was committed."""
        fs, p = self._fs(f"{self.path}/_marks/{quote(f'v-{name}', safe='')}")
        return fs.exists(p) or self.version() == f"v-{name}"

    def note(self, name: str) -> dict:
        """What the change of this name kept beside it."""
        return self._state(f"v-{name}")[1].get("note", {})

    def _rows(self, manifest: dict | None, buckets: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}/bucket={b}" for b, f in (manifest or {"files": {}})["files"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return conform(self.spark.read.schema(self.schema).parquet(*folders), self.schema)

    def read(self, version: str | None = None) -> DataFrame:
        state = self._state(version)
        return self._rows(state and state[1])

    def lookup(self, *ids: str) -> DataFrame:
        """Rows of these ids, out of the buckets that may have them."""
        state = self._state()
        if state is None:
            return self._rows(None)
        keys = self.spark.createDataFrame([(i,) for i in ids], f"{self.key} string").select(self._bucket(state[1]["buckets"]).alias("b")).distinct()
        return self._rows(state[1], {r.b for r in keys.collect()}).where(F.col(self.key).isin(*ids))

    # Changes.

    def _put(self, rows: DataFrame, version: str) -> dict[str, str]:
        """rows with their bucket, already in that bucket's task, as a new folder: (bucket: folder)."""
        folder = f"{version}-{uuid.uuid4().hex[:8]}"
        out = rows.sortWithinPartitions("bucket", self.key).write.partitionBy("bucket")
        for c in {self.key, *FILTERED} & set(rows.columns):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(f"{self.path}/{folder}")
        return {n.partition("=")[2]: folder for n in self._names(folder) if n.startswith("bucket=")}

    def write(self, jobs: DataFrame, name: str | None = None) -> str:
        """A whole new table in the place of the current one, whatever that holds."""
        version = f"v-{name or uuid.uuid4().hex}"
        if name and self.has(name):
            return version
        n = self.buckets or max(LEAST_BUCKETS, -(-sized(jobs) // BUCKET_BYTES))
        rows = conform(jobs, self.schema).withColumn("bucket", self._bucket(n))
        files = self._put(rows.repartition(n, "bucket"), version)
        for _ in range(TRIES):
            if self._commit(self._state(), {"version": version, "buckets": n, "files": files}):
                return version
        raise Conflict(version)

    def commit(self, change: Callable[[DataFrame], DataFrame], name: str | None = None, note: Callable[[], dict] | None = None) -> str:
        """Stores the rows that ``change`` makes of the current ones, each in the place of the row of its key. It is called again where another
        writer was first, and not at all where the name is known. note: what to keep beside it, asked once the rows are written."""
        version = f"v-{name or uuid.uuid4().hex}"
        for _ in range(TRIES):
            if name and self.has(name):
                return version
            state = self._state()
            if self._upsert(state, change(self._rows(state and state[1])), version, note):
                return version
        raise Conflict(version)

    def _upsert(self, state: tuple[int, dict] | None, rows: DataFrame, version: str, note: Callable[[], dict] | None) -> bool:
        n = state[1]["buckets"] if state else self.buckets or max(LEAST_BUCKETS, -(-sized(rows) // BUCKET_BYTES))
        new = written(conform(rows, self.schema).withColumn("bucket", self._bucket(n)), "change")
        try:
            touched = {r.bucket for r in new.select("bucket").distinct().collect()}
            files = dict(state[1]["files"]) if state else {}
            if touched:
                old = self._rows(state and state[1], touched).withColumns({"bucket": self._bucket(n), "__new": F.lit(False)})
                both = old.unionByName(new.withColumn("__new", F.lit(True))).repartition(max(1, len(touched)), "bucket")
                replaced = F.max("__new").over(Window.partitionBy("bucket", self.key))
                files |= self._put(both.withColumn("__replaced", replaced).where("__new or not __replaced").drop("__new", "__replaced"), version)
            return self._commit(state, {"version": version, "buckets": n, "files": files, "note": note() if note else {}})
        finally:
            discard(new)

    def _commit(self, state: tuple[int, dict] | None, manifest: dict) -> bool:
        if state:
            self._mark(state[1]["version"])
        if not self._point(state[0] + 1 if state else 0, manifest):
            return False
        self._mark(manifest["version"])
        return True

    def deactivate(self, ids: DataFrame) -> str:
        gone = ids.select("id").distinct()
        return self.commit(lambda rows: rows.where("is_active").join(gone, "id", "left_semi").withColumn("is_active", F.lit(False)))

    def expire(self, keep: int = 10) -> list[str]:
        """Removes the buckets' folders that none of the newest states needs; returns the versions that can no longer be read. Names stay known."""
        manifests = [self._manifest(n) for n in self._numbers()]
        needed = {x for m in manifests[-max(1, keep) :] for x in m["files"].items()}
        old = manifests[: -max(1, keep)]
        for bucket, folder in {x for m in old for x in m["files"].items()} - needed:
            fs, p = self._fs(f"{self.path}/{folder}/bucket={bucket}")
            fs.delete(p, True)
        return [m["version"] for m in old if not needed.issuperset(m["files"].items())]

    # Records that a run skipped.

    def bury(self, rows: DataFrame, name: str) -> None:
        """Keeps the records (source, url, error) that the change of this name left out; they count once it is committed."""
        rows.select("source", "url", "error").write.mode("overwrite").parquet(f"{self.path}/_skipped/{quote(f'v-{name}', safe='')}")

    def skipped(self) -> DataFrame:
        known = {*self._names("_marks"), quote(self.version() or "", safe="")}
        folders = [f"{self.path}/_skipped/{n}" for n in self._names("_skipped") if n in known]
        return self.spark.read.schema(SKIPPED).parquet(*folders) if folders else self.spark.createDataFrame([], SKIPPED)

    def probe(self) -> str:
        """connected or unreachable; never raises."""
        try:
            self.spark.sql("SELECT 1").collect()
            self.read().limit(0).collect()
            return "connected"
        except Exception:
            return "unreachable"


def dump_json(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("overwrite").json(path)
