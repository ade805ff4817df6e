"""A versioned graph store: Parquet snapshots, an append-only change log and optimistic transactions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.plans.gql import Create, Delete, parse
from graphloom.plans.matching import QueryError, created_rows, matched_ids

from .changelog import (
    ADD_EDGE, ADD_VERTEX, REMOVE_EDGE, REMOVE_VERTEX, SCHEMA, UPDATE_EDGE, UPDATE_VERTEX, as_changes, fold,
)

CHECKPOINT_EVERY = 10
STALE_SECONDS = 60


class Conflict(RuntimeError):
    """Another transaction was committed since this one began."""


@dataclass
class Transaction:
    """Operations against one version; nothing is visible before the commit."""

    base: int
    operations: list[dict] = field(default_factory=list)

    def add_vertex(self, vertex: int, **props) -> Transaction:
        return self._put(op=ADD_VERTEX, id=vertex, after=props)

    def remove_vertex(self, vertex: int) -> Transaction:
        return self._put(op=REMOVE_VERTEX, id=vertex)

    def update_vertex(self, vertex: int, **props) -> Transaction:
        return self._put(op=UPDATE_VERTEX, id=vertex, after=props)

    def add_edge(self, src: int, dst: int, label: str = "related", **props) -> Transaction:
        return self._put(op=ADD_EDGE, src=src, dst=dst, label=label, after=props)

    def remove_edge(self, src: int, dst: int, label: str = "related") -> Transaction:
        return self._put(op=REMOVE_EDGE, src=src, dst=dst, label=label)

    def update_edge(self, src: int, dst: int, label: str = "related", **props) -> Transaction:
        return self._put(op=UPDATE_EDGE, src=src, dst=dst, label=label, after=props)

    def _put(self, **operation) -> Transaction:
        if not -(2**63) <= operation.get("id", 0) < 2**63:
            raise ValueError("ids are signed 64-bit")
        self.operations.append(operation)
        return self


class GraphStore:
    """``path`` holds ``snapshots/<version>``, ``log/<from>-<to>-<token>`` and ``commits/<from>``.

    A commit writes its log and then creates ``commits/<from>``, which holds
    the log's name: that one exclusive create is the compare-and-set and the
    commit.  The file system needs an exclusive create.  A writer that dies
    between creating and filling the file leaves it empty; nothing was
    committed then, and after ``STALE_SECONDS`` the next commit takes its
    place.  Readers fold the log after the newest snapshot.
    """

    def __init__(self, spark: SparkSession, path: str, vertices: str, edges: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.vertices, self.edges = vertices, edges
        self.listeners: list[Callable[[DataFrame], None]] = []

    # files

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        target, fs = self._hadoop(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def _create(self, name: str, content: str) -> bool:
        """Whether the file is ours: made by nobody before, and with our content in the end."""
        target, fs = self._hadoop(f"{self.path}/{name}")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return self._content(name) == content

    def _content(self, name: str) -> str:
        target, fs = self._hadoop(f"{self.path}/{name}")
        if not fs.exists(target):
            return ""
        stream = fs.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _drop_stale(self, name: str) -> bool:
        """Whether a dead writer's empty file was there and is gone."""
        target, fs = self._hadoop(f"{self.path}/{name}")
        if not fs.exists(target) or self._content(name):
            return False
        age = time.time() - fs.getFileStatus(target).getModificationTime() / 1000
        return age > STALE_SECONDS and fs.delete(target, False)

    def _bases(self) -> list[int]:
        return [int(n) for n in self._names("commits") if n.isdigit()]

    def _log(self, base: int) -> str:
        """The log committed on a base version; empty if none is yet."""
        return self._content(f"commits/{base:020d}")

    # reading

    def version(self) -> int:
        """The number of operations committed so far."""
        for base in reversed(self._bases()):
            name = self._log(base)
            if name:
                return int(name.split("-")[1])
        return 0

    def snapshots(self) -> list[int]:
        """Versions with a finished snapshot of both tables."""
        done = []
        for name in self._names("snapshots"):
            if {"_SUCCESS"} <= set(self._names(f"snapshots/{name}/vertices")) & set(self._names(f"snapshots/{name}/edges")):
                done.append(int(name))
        return sorted(done)

    def graph(self, version: int | None = None) -> PropertyGraph:
        """The graph at a version (default: now)."""
        version = self.version() if version is None else version
        base = max((s for s in self.snapshots() if s <= version), default=0)
        if base or 0 in self.snapshots():
            at = f"{self.path}/snapshots/{base}"
            start = PropertyGraph(self.spark.read.schema(self.vertices).parquet(f"{at}/vertices"), self.spark.read.schema(self.edges).parquet(f"{at}/edges"))
        else:
            start = PropertyGraph(self.spark.createDataFrame([], self.vertices), self.spark.createDataFrame([], self.edges))
        log = self.changes(base, version)
        return start if log is None else fold(start, log)

    def changes(self, after: int = 0, until: int | None = None) -> DataFrame | None:
        """Committed changes with ``after < seq <= until``; None if there are none."""
        bases = self._bases()
        first = max((b for b in bases if b <= after), default=0)
        names = [self._log(b) for b in bases if b >= first and (until is None or b < until)]
        parts = [f"{self.path}/log/{n}" for n in names if n and int(n.split("-")[1]) > after]
        if not parts:
            return None
        found = self.spark.read.schema(SCHEMA).parquet(*parts).where(F.col("seq") > after)
        return found if until is None else found.where(F.col("seq") <= until)

    def stats(self) -> dict[str, int]:
        return {**self.graph().counts(), "version": self.version()}

    # writing

    def begin(self) -> Transaction:
        return Transaction(self.version())

    def rollback(self, transaction: Transaction) -> None:
        transaction.operations.clear()

    def commit(self, transaction: Transaction, source: str = "") -> int:
        """Make the operations durable and visible; the new version, one more for each."""
        if self.version() != transaction.base:
            raise Conflict(f"the version is {self.version()}, not {transaction.base}")
        if not transaction.operations:
            return transaction.base
        base, made = transaction.base, transaction.base + len(transaction.operations)
        token = f"{time.time_ns():020d}"
        rows = [{**o, "seq": base + k, "changeset_id": token, "source": source} for k, o in enumerate(transaction.operations, 1)]
        changes = as_changes(self.spark, rows)
        name = f"{base:020d}-{made:020d}-{token}"
        changes.coalesce(1).write.parquet(f"{self.path}/log/{name}")
        commit = f"commits/{base:020d}"
        if not self._create(commit, name) and not (self._drop_stale(commit) and self._create(commit, name)):
            raise Conflict(f"version {base} was built on")
        for listener in self.listeners:
            listener(changes)
        if made % CHECKPOINT_EVERY == 0:
            self.checkpoint()
        return made

    def checkpoint(self) -> int:
        """Write the current version as a snapshot."""
        version = self.version()
        if version not in self.snapshots():
            found = self.graph(version)
            found.vertices.write.mode("overwrite").parquet(f"{self.path}/snapshots/{version}/vertices")
            found.edges.write.mode("overwrite").parquet(f"{self.path}/snapshots/{version}/edges")
        return version

    def execute(self, text: str) -> DataFrame:
        """A CREATE or MATCH ... DELETE: the ids it made or removed."""
        statement = parse(text)
        transaction, graph = self.begin(), self.graph()
        if isinstance(statement, Create):
            vertices, edges = created_rows(graph, statement)
            for row in vertices:
                transaction.add_vertex(row["id"], **{k: v for k, v in row.items() if k != "id"})
            for row in edges:
                transaction.add_edge(row["src"], row["dst"], row["label"], **{k: v for k, v in row.items() if k not in ("src", "dst", "label")})
            ids = [(row["id"],) for row in vertices]
        elif isinstance(statement, Delete):
            # a transaction lists its operations, so its ids pass through the driver
            ids = [(r["id"],) for r in matched_ids(graph, statement).orderBy("id").toLocalIterator()]
            for (vertex,) in ids:
                transaction.remove_vertex(vertex)
        else:
            raise QueryError("MATCH ... RETURN reads; use query()")
        self.commit(transaction)
        return self.spark.createDataFrame(ids, "id long")
