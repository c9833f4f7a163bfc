"""Vector collections as immutable Parquet files behind a versioned manifest, merged on read.

A collection has base files, hash-bucketed by URI, and deltas. A commit writes one delta: the new rows, and a
tombstone for every URI that it replaces or removes; no older file is opened for writing. A reader sees a row
unless a later commit has a tombstone for its URI. ``compact`` folds the deltas into the buckets they touch,
leaves all other buckets alone and brings the approximate index up to date; a :class:`FoldPolicy` says when
the write path does so by itself.

Manifests are created exclusively, so of two writers racing for one version the second fails
instead of losing the first one's work; readers resolve one manifest and keep a consistent view while
later commits happen.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.ann import ANN_MIN_ROWS, AnnParams, CodeIndex
from corvane.operators.lifecycle import compaction_due
from corvane.operators.topk import best_of, exact_topk
from corvane.schema import CHUNKS, SOURCES, Collection, DimensionError, StoreError, checked_vector
from corvane.session import cut_lineage

FEW_HITS = 200_000  # hits or tombstones that are broadcast at most

ROW_COLUMNS = [f.name for f in CHUNKS.fields]
SOURCE_ROWS = T.StructType([*SOURCES.fields, T.StructField("seq", T.LongType(), False)])
SOURCE_COLUMNS = [f.name for f in SOURCE_ROWS.fields]
TOMBS = T.StructType([T.StructField("uri", T.StringType(), False), T.StructField("seq", T.LongType(), False)])


@dataclass(frozen=True)
class FoldPolicy:
    """When a commit folds the deltas: after so many rows and tombstones, seconds or commits; 0 or less turns one off."""

    after_records: int = 100_000
    after_seconds: float = 0.0
    after_commits: int = 32


class _Files:
    """The few file operations a manifest needs, on whatever file system the root lives."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, *parts: str) -> dict:
        path = self._path(*parts)
        stream = self._fs(path).open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, data: dict, *parts: str) -> None:
        path = self._path(*parts)
        stream = self._fs(path).create(path, False)
        try:
            stream.write(bytearray(json.dumps(data, sort_keys=True).encode("utf-8")))
        finally:
            stream.close()

    def delete(self, *parts: str) -> None:
        path = self._path(*parts)
        self._fs(path).delete(path, True)


class VectorTable:
    """Every collection under one root folder."""

    def __init__(
        self, spark: SparkSession, root: str, buckets: int = 32, *, fold: FoldPolicy | None = None,
        ann_min_rows: int = ANN_MIN_ROWS, ann_cells: int | None = None, clock: Callable[[], float] = time.time,
    ) -> None:
        self.spark, self.buckets, self.fold, self.clock = spark, buckets, fold or FoldPolicy(), clock
        self.ann_min_rows, self.ann_cells = ann_min_rows, ann_cells
        self.files = _Files(spark, root)
        self.root = self.files.root

    # -- manifests -----------------------------------------------------------------------------

    def _latest(self, name: str) -> tuple[int, dict] | None:
        versions = [n for n in self.files.names("manifests", name) if n.endswith(".json") and not n.startswith(".")]
        if not versions:
            return None
        try:
            data = self.files.read("manifests", name, versions[-1])
            data["paths"], data["dim"], data["model_id"]  # noqa: B018 - a damaged manifest fails here
        except (ValueError, KeyError) as exc:
            raise StoreError(f"collection {name!r}: damaged manifest {versions[-1]}") from exc
        return int(versions[-1].split(".")[0]), data

    def _need(self, name: str) -> tuple[int, dict]:
        found = self._latest(name)
        if found is None or found[1].get("dropped"):
            raise StoreError(f"unknown collection {name!r}")
        return found

    def _publish(self, name: str, version: int, data: dict) -> None:
        self.files.create(data, "manifests", name, f"{version:012d}.json")

    # -- catalogue -----------------------------------------------------------------------------

    def ensure(self, c: Collection) -> None:
        """Create the collection; an existing one must agree on model and width."""
        found = self._latest(c.name)
        if found and not found[1].get("dropped"):
            if (found[1]["model_id"], found[1]["dim"]) != (c.model_id, c.dim):
                raise StoreError(f"collection {c.name!r} is pinned to {found[1]['model_id']}/{found[1]['dim']}")
            return
        fresh = {"model_id": c.model_id, "dim": c.dim, "buckets": self.buckets, "paths": {"chunks": {}, "sources": {}}, "deltas": [], "batches": {}}
        self._publish(c.name, found[0] + 1 if found else 0, fresh)

    def names(self) -> list[str]:
        return [n for n in self.files.names("manifests") if not (self._latest(n) or (0, {"dropped": 1}))[1].get("dropped")]

    def collections(self) -> DataFrame:
        rows = [(n, self._need(n)[1]["model_id"], int(self._need(n)[1]["dim"])) for n in self.names()]
        return self.spark.createDataFrame(rows, "name string, model_id string, dim int")

    def exists(self, name: str) -> bool:
        found = self._latest(name)
        return found is not None and not found[1].get("dropped")

    def last_batch(self, name: str, stream: str = "") -> int:
        """The last batch that ``stream`` has committed; numbers of different streams are apart."""
        return int(self._need(name)[1].get("batches", {}).get(stream, -1))

    # -- reading -------------------------------------------------------------------------------

    def _scan(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def _tombs(self, data: dict) -> DataFrame | None:
        """The last commit that replaced or removed each URI since the last fold."""
        deltas = data.get("deltas", [])
        if not deltas:
            return None
        gone = self._scan([f"{d['path']}/gone" for d in deltas], TOMBS).groupBy("uri").agg(F.max("seq").alias("gone_at"))
        return F.broadcast(gone) if sum(d["gone"] for d in deltas) <= FEW_HITS else gone

    def _read(self, data: dict, kind: str, *, base: bool = True, buckets: list[int] | None = None) -> DataFrame:
        """The visible rows of a kind: of the deltas, and of all or the given base buckets."""
        schema = CHUNKS if kind == "chunks" else SOURCE_ROWS
        named = {b: p for b, p in data["paths"][kind].items() if buckets is None or int(b) in buckets} if base else {}
        deltas = [f"{d['path']}/{kind}" for d in data.get("deltas", []) if d[kind]]
        rows = self._scan([f"{p}/{kind}/bucket={b}" for b, p in named.items()] + deltas, schema)
        tombs = self._tombs(data)
        if tombs is None:
            return rows
        return rows.join(tombs, "uri", "left").where(F.col("gone_at").isNull() | (F.col("seq") >= F.col("gone_at"))).drop("gone_at")

    def rows(self, name: str) -> DataFrame:
        return self._read(self._need(name)[1], "chunks")

    def sources(self, name: str) -> DataFrame:
        """Every indexed source, those without chunks included."""
        return self._read(self._need(name)[1], "sources").drop("seq")

    def count(self, name: str) -> int:
        return self.rows(name).count() if self.exists(name) else 0

    def source_hashes(self, name: str) -> DataFrame:
        return self.sources(name).select("uri", "content_hash")

    def tail(self, name: str) -> dict[str, int]:
        """What waits for the next fold: ``commits``, and the ``records`` (rows and tombstones) in them."""
        deltas = self._need(name)[1].get("deltas", [])
        return {"commits": len(deltas), "records": sum(d["chunks"] + d["gone"] for d in deltas)}

    def search(self, name: str, queries: DataFrame, k: int = 5, params: AnnParams | None = None) -> DataFrame:
        """Top-k with the hit's columns; ties go to the earlier commit, then ``(uri, ordinal)``.

        Exact, unless ``params`` sets ``nprobes`` and the collection has an index: then every query looks at the codes
        of its ``nprobes`` nearest cells, the best ``k * refine_factor`` of them are ranked by their exact scores, and the
        rows that came after the last fold are scanned exactly beside them. Scores are exact either way.
        """
        data = self._need(name)[1]
        dim = int(data["dim"])
        width = queries.select(F.size("vector").alias("w")).where(F.col("w") != dim).first()
        if width is not None:
            raise DimensionError(f"collection {name!r} has width {dim}, a query has {width['w']}")
        keys = ["seq", "uri", "ordinal"]
        rows = self._read(data, "chunks")
        if params is not None and params.nprobes and data.get("index"):
            index = CodeIndex(self.spark, f"{self.root}/{data['index']['path']}")
            near = cut_lineage(index.candidates(queries, k * (params.refine_factor or 1), dim=dim, keys=keys, nprobes=params.nprobes))
            folded = self._read(data | {"deltas": []}, "chunks")
            tombs = self._tombs(data)
            if tombs is not None:
                near = near.join(tombs, "uri", "left_anti")
            exact = index.rescored(near, folded, queries, keys, FEW_HITS)
            if data.get("deltas"):
                exact = exact.unionByName(exact_topk(self._read(data, "chunks", base=False), queries, k, dim=dim, keys=keys).drop("rank"))
            hits = best_of(exact, k, keys)
        else:
            hits = exact_topk(rows, queries, k, dim=dim, keys=keys)
        hits = cut_lineage(hits)
        hits = F.broadcast(hits) if hits.count() <= FEW_HITS else hits  # few hits go to the texts
        payload = rows.select("uri", "ordinal", "label", "summary", F.col("text").alias("chunk_text"))
        return payload.join(hits, ["uri", "ordinal"]).select(
            "qid", "rank", "chunk_text", "score", "uri", "ordinal", "label", F.lit(name).alias("collection"), "summary"
        )

    # -- writing -------------------------------------------------------------------------------

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64("uri"), F.lit(n)).cast("int")

    def replace(
        self, name: str, rows: DataFrame | None, sources: DataFrame | None, removed: DataFrame | None = None,
        *, batch: int | None = None, stream: str = "",
    ) -> bool:
        """Drop every row of the URIs in ``sources`` and ``removed``, add ``rows``; one commit, and a fold when it is due.

        ``sources`` lists all sources being written, also those that yield no chunks. With a
        ``batch`` number the commit is idempotent: a batch at or before its stream's last one is a no-op. Removing
        what the collection does not have writes nothing.
        """
        version, data = self._need(name)
        if batch is not None and batch <= self.last_batch(name, stream):
            return False
        if sources is None and removed is None:
            return False
        seq, dim = version + 1, int(data["dim"])
        batches = data.get("batches", {}) | ({} if batch is None else {stream: batch})
        new = None if rows is None else rows.withColumn("vector", checked_vector(F.col("vector"), dim)).withColumn("seq", F.lit(seq).cast("long")).select(*ROW_COLUMNS)
        listed = None if sources is None else sources.withColumn("seq", F.lit(seq).cast("long")).select(*SOURCE_COLUMNS)
        folder = f"data/{name}/{uuid.uuid4().hex}"
        if not any(data["paths"].values()) and not data.get("deltas"):  # the first rows are base files at once
            paths = self._file(folder, {"chunks": new, "sources": listed}, int(data["buckets"]))
            if any(paths.values()) or batch is not None:
                self._publish(name, seq, {**data, "paths": paths, "batches": batches, "since": self.clock()})
            return True
        gone = [] if listed is None else [listed.select("uri")]
        if removed is not None:
            held = self._read(data, "sources").select("uri").union(self._read(data, "chunks").select("uri"))
            gone.append(removed.select("uri").join(held, "uri", "left_semi"))
        tombs = (gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])).distinct().withColumn("seq", F.lit(seq).cast("long"))
        delta = {"path": folder, "seq": seq, "gone": self._append(f"{folder}/gone", tombs)}
        if delta["gone"]:
            delta |= {k: self._append(f"{folder}/{k}", t) for k, t in (("chunks", new), ("sources", listed))}
            data["deltas"] = [*data.get("deltas", []), delta]
        else:  # nothing that the collection has
            self.files.delete(folder)
        if delta["gone"] or batch is not None:
            self._publish(name, seq, {**data, "batches": batches})
        if delta["gone"] and self.due(name):
            self.compact(name)
        return True

    def _append(self, folder: str, table: DataFrame | None) -> int:
        """Rows written to ``folder``, in few large files."""
        if table is None:
            return 0
        table.hint("rebalance").write.parquet(f"{self.root}/{folder}")
        return self.spark.read.schema(table.schema).parquet(f"{self.root}/{folder}").count()

    def _file(self, folder: str, tables: dict[str, DataFrame | None], n: int) -> dict[str, dict[str, str]]:
        """Rows filed by bucket below ``folder``; per kind the buckets that came to be."""
        found: dict[str, dict[str, str]] = {}
        for kind, table in tables.items():
            found[kind] = {}
            if table is not None:
                # Rebalancing by bucket keeps files large and still splits a bucket one URI has filled.
                filed = table.withColumn("bucket", self._bucket(n)).hint("rebalance", F.col("bucket"))
                filed.write.partitionBy("bucket").parquet(f"{self.root}/{folder}/{kind}")
                found[kind] = {f.partition("=")[2]: folder for f in self.files.names(folder, kind) if f.startswith("bucket=")}
        return found

    def delete(self, name: str, uris: DataFrame) -> None:
        """Delete every row of the given URIs; unknown URIs are fine."""
        self.replace(name, None, None, uris)

    def swap(self, staging: str, target: str) -> None:
        """The target takes over the staging collection's files, model and width; staging goes."""
        version, data = self._need(staging)
        old = self._latest(target)
        own = old[1].get("batches", {}) if old else {}  # the target's streams go on where they were
        # versions of the target go on above those of the files, so that later tombstones find the rows
        self._publish(target, max(version, old[0] if old else 0) + 1, {**data, "batches": own})
        self._publish(staging, version + 1, {**data, "paths": {"chunks": {}, "sources": {}}, "deltas": [], "index": None, "dropped": True})

    def vacuum(self, name: str) -> int:
        """Remove the data folders of the collection that no manifest names any more; how many went.

        A swapped collection's files lie under its staging name, so all collections are asked. Not while an
        older view is being read: that view's files are what goes.
        """
        used: set[str] = set()
        for n in self.names():
            data = self._need(n)[1]
            used |= {p for kind in data["paths"].values() for p in kind.values()} | {d["path"] for d in data.get("deltas", [])}
            used |= {data["index"]["path"]} if data.get("index") else set()
        gone = [f for f in self.files.names("data", name) if f"data/{name}/{f}" not in used]
        for folder in gone:
            self.files.delete("data", name, folder)
        return len(gone)

    # -- folding -------------------------------------------------------------------------------

    def due(self, name: str) -> bool:
        """Whether the policy wants the deltas folded now."""
        tail, data = self.tail(name), self._need(name)[1]
        if 0 < self.fold.after_commits <= tail["commits"]:
            return True
        waited = self.clock() - data.get("since", self.clock())
        one = self.spark.createDataFrame([(tail["records"], float(waited))], "records long, seconds double")
        return one.select(compaction_due(F.col("records"), F.col("seconds"), self.fold.after_records, self.fold.after_seconds)).first()[0]

    def compact(self, name: str) -> None:
        """Fold the deltas into the buckets they touch and bring the index up to date; rows and their ``seq`` stay.

        The other buckets' files are neither read nor written. The index is built by the first fold that finds
        ``ann_min_rows`` rows; later folds drop the codes of replaced URIs and add those of the new rows.
        """
        version, data = self._need(name)
        n, tombs = int(data["buckets"]), self._tombs(data)
        paths = data["paths"]
        if tombs is not None:
            touched = sorted(r[0] for r in tombs.select(self._bucket(n)).distinct().collect())  # at most n numbers
            folder = f"data/{name}/{uuid.uuid4().hex}"
            made = self._file(folder, {kind: self._read(data, kind, buckets=touched) for kind in ("chunks", "sources")}, n)
            paths = {kind: {b: p for b, p in old.items() if int(b) not in touched} | made[kind] for kind, old in paths.items()}
        folded = {**data, "paths": paths, "deltas": []}
        index = self._index(name, data, folded, tombs)
        if tombs is not None or index != data.get("index"):
            self._publish(name, version + 1, {**folded, "index": index, "since": self.clock()})

    def _index(self, name: str, data: dict, folded: dict, tombs: DataFrame | None) -> dict | None:
        old, folder = data.get("index"), f"data/{name}/{uuid.uuid4().hex}"
        index = CodeIndex(self.spark, f"{self.root}/{folder}")
        keys = ["seq", "uri", "ordinal"]
        if old is None:
            rows = self._read(folded, "chunks")
            if rows.limit(self.ann_min_rows).count() < self.ann_min_rows:
                return None
            index.train(rows, int(data["dim"]), self.ann_cells).add(rows, keys)
        elif tombs is None:
            return old
        else:
            last = CodeIndex(self.spark, f"{self.root}/{old['path']}")
            index.follow(last, tombs.select("uri")).add(self._read(data, "chunks", base=False), keys)
        return {"path": folder}
