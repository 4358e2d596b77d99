"""Tables and models kept between queries, found by what they were made from.

An artefact's key is a hash of its name, its settings and the files it reads
(names, sizes, times of change), so changed input or settings miss and are
built anew.  Data go to a folder of their own; a small manifest that names the
folder is put in place by an atomic rename, so readers see a whole artefact or
none, and of two writers one wins.  Everything goes through the Hadoop file
system of the path, never through local files.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import checkpoint_dir
from .sinks import write_table

#: Part of every key: raise it when an artefact's content changes with the code.
VERSION = 1

#: Bytes of a kept table's row groups unless a smaller size is asked for: a task that
#: writes holds one of them in memory (Parquet's own 128 MB would fill an executor's).
ROW_GROUP = 16 << 20

_locks: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)


def alone(path: str) -> threading.Lock:
    """The lock of an artefact: of this process's threads one builds, the others wait."""
    return _locks[path]


def artefact_root(spark: SparkSession) -> str:
    """The shared folder of all artefacts: ``spark.shipgraph.artefacts``, else
    a folder under the session's checkpoint folder."""
    own = spark.conf.get("spark.shipgraph.artefacts", "")
    return (own or f"{checkpoint_dir(spark).rstrip('/')}/artefacts").rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside ``path`` and rename it over: all or nothing."""
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    temp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(temp)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    try:
        context.rename(fs.makeQualified(temp), fs.makeQualified(p), options)
    except Py4JJavaError as e:  # another writer was a moment earlier: its file stands
        fs.delete(temp, False)
        if "FileAlreadyExists" not in str(e.java_exception):
            raise


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Hash of the files under ``paths``: names, sizes and times of change."""
    seen = []
    for path in paths:
        fs, p = _path(spark, path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            s = files.next()
            seen.append((s.getPath().toUri().getPath(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(seen)).encode()).hexdigest()


def artefact_key(spark: SparkSession, name: str, inputs: list[str], settings: dict) -> str:
    facts = [VERSION, name, settings, fingerprint(spark, inputs)]
    return hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()[:24]


def table(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame],
          settings: dict | None = None, partition_by: list[str] | None = None,
          force_rebuild: bool = False, row_group: int | None = ROW_GROUP) -> DataFrame:
    """SRC2/SRC4/SNK1: the table ``build`` makes from ``inputs``, built once
    per content of the inputs and settings, read back as Parquet (pruned by
    ``partition_by``), in row groups of ``row_group`` bytes.  ``force_rebuild`` builds and publishes it again."""
    root = f"{artefact_root(spark)}/{name}"
    manifest = f"{root}/{artefact_key(spark, name, inputs, settings or {})}.json"
    with alone(manifest):
        if force_rebuild or not exists(spark, manifest):
            data = f"{root}/data-{uuid.uuid4().hex}"
            out = build()
            write_table(out, data, partition_by=partition_by, row_group=row_group)
            publish_text(spark, manifest, json.dumps({
                "data": data, "schema": out.schema.jsonValue(), "settings": settings or {},
                "partition_by": partition_by or []}))
    found = json.loads(read_text(spark, manifest))
    return spark.read.schema(T.StructType.fromJson(found["schema"])).parquet(found["data"])


class ModelStore:
    """SNK3/SRC5: fitted pipelines by name under one folder, each with a manifest
    of its facts (family, route type, features, settings, rows it was fitted on)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self, name: str) -> str:
        return f"{self.path}/{name}.json"

    def names(self) -> list[str]:
        return [n[:-5] for n in children(self.spark, self.path) if n.endswith(".json")]

    def facts(self, name: str) -> dict:
        if not exists(self.spark, self._manifest(name)):
            raise FileNotFoundError(f"no model {name!r} in {self.path}; there are {self.names()}")
        return json.loads(read_text(self.spark, self._manifest(name)))

    def save(self, name: str, model: PipelineModel, **facts) -> None:
        """Write the model, then its manifest; a model of that name is replaced."""
        data = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
        model.write().save(data)
        publish_text(self.spark, self._manifest(name), json.dumps(facts | {"data": data}))

    def load(self, name: str) -> PipelineModel:
        return PipelineModel.load(self.facts(name)["data"])

    def get(self, name: str, fit: Callable[[], PipelineModel], **facts) -> PipelineModel:
        """The stored model, fitted and stored first if there is none."""
        if not exists(self.spark, self._manifest(name)):
            self.save(name, fit(), **facts)
        return self.load(name)


def merged_models(stores: list[ModelStore]) -> dict[tuple[str, str], PipelineModel]:
    """SRC5: the route models of all stores as {(family, route type): model}; a
    later store's model replaces an earlier one's.  No model at all raises."""
    found = {}
    for store in stores:
        for name in store.names():
            facts = store.facts(name)
            if facts.get("family") and facts.get("route_type"):
                found[facts["family"], facts["route_type"]] = (store, name)
    if not found:
        raise FileNotFoundError(f"no route model in {[s.path for s in stores]}")
    return {key: store.load(name) for key, (store, name) in found.items()}


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """SNK2: the rows of a JSON report; a missing one raises FileNotFoundError."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.json(path)


def release(spark: SparkSession, name: str, manifest_key: str) -> bool:
    """Delete one artefact's manifest and data; False if there was none."""
    manifest = f"{artefact_root(spark)}/{name}/{manifest_key}.json"
    if not exists(spark, manifest):
        return False
    data = json.loads(read_text(spark, manifest))["data"]
    for path in (manifest, data):
        fs, p = _path(spark, path)
        fs.delete(p, True)
    return True
