"""The store: versions of documents, nodes and chunks in Parquet, committed one after the other.

A commit is one file of the log, named by its version; it lists the segments that the version consists of. A segment is a folder that a
transaction has written: rows by table, in buckets of document_id, and the documents whose older rows it takes away. Rows count if no later
segment takes their document away, so indexing a document again replaces it. A segment that no commit names, as of a writer that died, is
never read.

A writer puts its segment down first and then creates the file of the next version, which fails if another writer was faster; it then
looks at the new state and tries again. Adding and deleting need no rows of the state, so their segment is used as it is; transactions that
depend on what they have read are run again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION, METRIC, BUCKETS = 2, "cosine", 16
#: Commits that a writer tries; segments at which add() compacts the store.
TRIES, MOST_SEGMENTS = 100, 12
SCHEMAS = {
    "documents": "document_id bigint, filename string, file_path string, upload_time timestamp",
    "nodes": "document_id bigint, node_id int, heading string, level int, parent_id int, path string, is_leaf int, content string, summary string, start_page int, end_page int, token_count int, start_line int, end_line int",
    "chunks": "chunk_id string, document_id bigint, node_id int, p_idx int, path string, heading string, start_page int, content string, embedding array<float>",
}


class Conflict(Exception):
    """Another writer has committed the version."""


class Log:
    """Numbered files of JSON in a folder. Each is created once, whole, or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.path = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path)

    def _at(self, version: int):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, f"{version:020d}.json")

    def last(self) -> int:
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path)]
        return max((int(x[:20]) for x in names if x[:20].isdigit() and x.endswith(".json")), default=0)

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._at(version))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, version: int, state: dict) -> None:
        """Writes under another name and renames, which is atomic; Conflict if the version is there."""
        target, own = self._at(version), self.jvm.org.apache.hadoop.fs.Path(self.path, f".{uuid.uuid4().hex}")
        stream = self.fs.create(own, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                # a local rename would replace the file; a link does not
                os.link(own.toUri().getPath(), target.toUri().getPath())
            else:
                none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(own, target, none)
        except FileExistsError as error:
            raise Conflict(version) from error
        except Exception as error:
            if self.fs.exists(target):
                raise Conflict(version) from error
            raise
        finally:
            self.fs.delete(own, False)


def bucket(document_id):
    return F.pmod(F.xxhash64(document_id), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, model_key: str):
        """A store of another schema version, metric or embedding model is reset, as its vectors could not be compared: its chunks go, documents and nodes only if their schema differs."""
        self.spark, self.root, self.model_key = spark, root.rstrip("/"), model_key
        self.log = Log(spark, f"{self.root}/log")

        def reset(state: dict) -> dict | None:
            own = {"schema": SCHEMA_VERSION, "metric": METRIC, "model_key": model_key}
            if all(state.get(k) == v for k, v in own.items()):
                return None
            # of the tables that go, segments up to this version no longer count
            gone = SCHEMAS if state.get("schema") != SCHEMA_VERSION else ["chunks"]
            return state | own | {"floor": state["floor"] | dict.fromkeys(gone, state["version"])}

        self._commit(reset)

    # versions

    def state(self, version: int | None = None) -> dict:
        version = self.log.last() if version is None else version
        return self.log.read(version) if version else {"version": 0, "segments": [], "floor": dict.fromkeys(SCHEMAS, 0)}

    def _commit(self, change: Callable[[dict], dict | None]) -> int:
        """Commits change(state), which gets the newest state each time; None leaves it. The version that holds the change."""
        for _ in range(TRIES):
            state = self.state()
            new = change(state)
            if new is None:
                return state["version"]
            version = state["version"] + 1
            try:
                self.log.create(version, new | {"version": version})
            except Conflict:
                continue
            return version
        raise Conflict(f"{TRIES} other commits came first")

    # segments

    def _segment(self, tables: dict[str, DataFrame], gone: DataFrame | None) -> dict:
        """Writes a segment: rows by table, and gone (document_id, table: whose older rows in which table no longer count). Nothing is visible before it is committed."""
        name = uuid.uuid4().hex
        for table, rows in tables.items():
            columns = self.spark.createDataFrame([], SCHEMAS[table]).schema
            rows = rows.select(*[(F.col(c.name) if c.name in rows.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in columns])
            rows.withColumn("bucket", bucket("document_id")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/segments/{name}/{table}")
        if gone is not None:
            gone.distinct().withColumn("bucket", bucket("document_id")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/segments/{name}/gone")
        return {"name": name, "tables": list(tables), "gone": gone is not None}

    def _append(self, segment: dict) -> int:
        return self._commit(lambda state: state | {"segments": [*state["segments"], segment | {"seq": state["version"] + 1}]})

    def _rows(self, table: str, segment: dict, document_id: int | None) -> DataFrame:
        schema = SCHEMAS[table] if table in SCHEMAS else "document_id bigint, table string"
        rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.root}/segments/{segment['name']}/{table}")
        if document_id is not None:
            rows = rows.where((F.col("bucket") == bucket(F.lit(document_id).cast("bigint"))) & (F.col("document_id") == document_id))
        return rows.withColumn("seq", F.lit(segment["seq"]))

    def _live(self, table: str, state: dict, document_id: int | None = None) -> DataFrame:
        segments = [s for s in state["segments"] if table in s["tables"] and s["seq"] > state["floor"][table]]
        if not segments:
            return self.spark.createDataFrame([], SCHEMAS[table])
        rows = None
        for s in segments:
            part = self._rows(table, s, document_id)
            rows = part if rows is None else rows.unionByName(part)
        last = None
        for s in (s for s in state["segments"] if s["gone"] and s["seq"] > segments[0]["seq"]):
            part = self._rows("gone", s, document_id)
            last = part if last is None else last.unionByName(part)
        if last is not None:
            last = last.where(F.col("table") == table).groupBy("document_id").agg(F.max("seq").alias("gone"))
            rows = rows.join(last, "document_id", "left").where("gone is null or seq >= gone").drop("gone")
        return rows.select(*self.spark.createDataFrame([], SCHEMAS[table]).columns)

    def _gone(self, ids: DataFrame, tables) -> DataFrame:
        return ids.select("document_id", F.explode(F.array(*map(F.lit, tables))).alias("table"))

    # rows

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of the newest or another version."""
        return self._live(name, self.state(version))

    def add(self, documents: DataFrame, nodes: DataFrame, chunks: DataFrame) -> int:
        """All parts of the documents at once; documents that are there already are replaced whole. The version."""
        rows = {"documents": documents.withColumn("upload_time", F.current_timestamp()), "nodes": nodes, "chunks": chunks}
        version = self._append(self._segment(rows, self._gone(documents.select("document_id"), SCHEMAS)))
        if len(self.state()["segments"]) > MOST_SEGMENTS:
            self.compact()
        return version

    def delete(self, document_id: int) -> int:
        ids = self.spark.createDataFrame([(document_id,)], "document_id bigint")
        return self._append(self._segment({}, self._gone(ids, SCHEMAS)))

    def delete_all(self, ids: DataFrame) -> int:
        """ids (document_id)."""
        return self._append(self._segment({}, self._gone(ids, SCHEMAS)))

    def set_path(self, filename: str, path: str) -> int:
        """For every document of that file name."""
        made: dict[int, dict] = {}

        def change(state: dict) -> dict:
            # depends on the rows of this state, so each try writes its own segment
            rows = self._live("documents", state).where(F.col("filename") == filename).withColumn("file_path", F.lit(path))
            made[0] = self._segment({"documents": rows}, self._gone(rows.select("document_id"), ["documents"]))
            return state | {"segments": [*state["segments"], made[0] | {"seq": state["version"] + 1}]}

        return self._commit(change)

    def compact(self) -> int:
        """Writes what counts of all segments as one. Segments that are added meanwhile stay behind it; if another writer has compacted, its work is kept."""
        before = self.state()
        merged = before["segments"]
        if len(merged) < 2:
            return before["version"]
        one = self._segment({name: self._live(name, before) for name in SCHEMAS}, None) | {"seq": merged[-1]["seq"]}

        def change(state: dict) -> dict | None:
            if state["segments"][: len(merged)] != merged or state["floor"] != before["floor"]:
                return None
            return state | {"segments": [one, *state["segments"][len(merged) :]]}

        return self._commit(change)

    def vacuum(self) -> list[str]:
        """Deletes the folders of segments that the newest version does not name, and gives their names. Not while others write or read older versions."""
        named = {s["name"] for s in self.state()["segments"]}
        path = self.log.jvm.org.apache.hadoop.fs.Path(f"{self.root}/segments")
        found = [x.getPath() for x in self.log.fs.listStatus(path)] if self.log.fs.exists(path) else []
        gone = [x for x in found if x.getName() not in named]
        for x in gone:
            self.log.fs.delete(x, True)
        return sorted(x.getName() for x in gone)

    def list_documents(self) -> DataFrame:
        return self.read("documents").orderBy(F.desc("upload_time"), F.desc("document_id"))

    def document(self, document_id: int):
        return self._live("documents", self.state(), document_id).first()

    def nodes(self, document_id: int) -> DataFrame:
        """Reads the document's bucket only."""
        return self._live("nodes", self.state(), document_id).orderBy("node_id")

    def node(self, document_id: int, node_id: int):
        return self.nodes(document_id).where(F.col("node_id") == node_id).first()

    def children(self, document_id: int, parent_id: int | None) -> DataFrame:
        narrow = self.nodes(document_id).select("document_id", "node_id", "heading", "level", "parent_id", "path", "is_leaf", "summary", "start_page", "end_page")
        return narrow.where(F.col("parent_id").eqNullSafe(F.lit(parent_id)))
