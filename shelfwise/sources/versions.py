"""A versioned vector index in a shared folder.

Vector files and tombstone files (ids taken out) are written once and never changed; a
version is a small manifest that lists them::

    <path>/data/<name>/      Parquet: vec_id, embedding and whatever else the index holds
    <path>/gone/<name>/      Parquet: vec_id
    <path>/log/<version>     JSON: files with the number of the change that wrote them

A change writes its files first and then its manifest, by renaming a finished file to a
name that must not exist. A reader that opened version v therefore sees v for good, a
writer that dies leaves files nothing refers to, and of two writers that race for a
version one gets :class:`VersionConflict`; :func:`add` and :func:`remove` then check again
against the version that won. Ids are taken out at reading by an anti-join on (vec_id,
number of the change): a tombstone hides what was added before it, so an id may come back.
:func:`compact` writes the live rows of a version anew.

Files are reached through Spark and its Hadoop file systems only, so any store Spark knows
will do, given one whose rename fails on an existing name (HDFS, a local disk).

Defined cases: adding an id that is live, a vector of another dimension, a null id or
vector raises and changes nothing; repeated ids within one add raise; removing ids that are
not there is a version like any other; an index may become empty and be added to again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETRIES = 8


class VersionConflict(RuntimeError):
    """Another writer has taken this version."""


def _log(spark: SparkSession, path: str):
    """(file context, path constructor, log folder) of the index."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/log")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return folder.getFileSystem(conf), hadoop, folder, conf


def versions(spark: SparkSession, path: str) -> list[int]:
    """All committed versions, rising."""
    fs, _, folder, _ = _log(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version (by default the latest one)."""
    known = versions(spark, path)
    if not known:
        raise ValueError(f"{path} holds no index")
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"{path} has no version {version}")
    return json.loads(spark.read.text(f"{path}/log/{version:012d}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, body: dict) -> int:
    fs, hadoop, folder, conf = _log(spark, path)
    fs.mkdirs(folder)
    draft = hadoop.Path(folder, f"_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    target = hadoop.Path(folder, f"{body['version']:012d}")
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = hadoop.FileContext.getFileContext(folder.toUri(), conf)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), none)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise VersionConflict(f"{path} already has a version {body['version']}") from None
        raise
    return body["version"]


def _write(df: DataFrame, path: str, kind: str) -> str:
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/{kind}/{name}")
    return name


def _checked(vectors: DataFrame, dim: int | None) -> tuple[int, int]:
    """(rows, dimension) of what is to be added."""
    s = vectors.agg(F.count(F.lit(1)).alias("n"), F.count("vec_id").alias("ids"), F.count("embedding").alias("vectors"),
                    F.countDistinct("vec_id").alias("distinct"), F.min(F.size("embedding")).alias("low"),
                    F.max(F.size("embedding")).alias("high")).first()
    if s["ids"] < s["n"] or s["vectors"] < s["n"]:
        raise ValueError("a vector or its id is missing")
    if s["distinct"] < s["n"]:
        raise ValueError("an id stands more than once among the vectors to add")
    if s["n"] and (s["low"] != s["high"] or dim not in (None, s["high"])):
        raise ValueError(f"Embedding dimension doesn't match index dimension {dim if dim is not None else s['low']}")
    return s["n"], s["high"] if s["n"] else dim


def _changed(spark: SparkSession, path: str, change: Callable[[dict], dict]) -> int:
    """Commit ``change`` of the latest manifest, again from the new one if another writer was first."""
    for _ in range(RETRIES):
        before = manifest(spark, path)
        try:
            return _commit(spark, path, {**change(before), "version": before["version"] + 1})
        except VersionConflict:
            continue
    raise VersionConflict(f"{RETRIES} other writers came first")


def create(vectors: DataFrame, path: str, **about) -> int:
    """Version 1 of a new index (``about``: whatever its manifest should say besides)."""
    spark = vectors.sparkSession
    if versions(spark, path):
        raise VersionConflict(f"{path} already holds an index")
    n, dim = _checked(vectors, None)
    body = {"version": 1, "data": [[1, _write(vectors, path, "data")]], "gone": [], "dim": dim, "total": n,
            "schema": vectors.schema.json(), **about}
    return _commit(spark, path, body)


def add(vectors: DataFrame, path: str) -> int:
    """A version with these vectors too. The files are written once, the checks
    are made against every version the change is tried on."""
    spark = vectors.sparkSession
    first = manifest(spark, path)
    columns = spark.read.schema(_schema(first)).parquet(f"{path}/data/{first['data'][0][1]}").columns
    n, dim = _checked(vectors, first["dim"])
    name = _write(vectors.select(*columns), path, "data")
    added = spark.read.schema(_schema(first)).parquet(f"{path}/data/{name}").select("vec_id")

    def change(m: dict) -> dict:
        if m["dim"] not in (None, dim):
            raise ValueError(f"Embedding dimension doesn't match index dimension {m['dim']}")
        if added.join(_live(spark, path, m).select("vec_id"), "vec_id", "left_semi").limit(1).count():
            raise ValueError("an id to add is in the index")
        return {**m, "data": [*m["data"], [m["version"] + 1, name]], "dim": dim, "total": m["total"] + n}
    return _changed(spark, path, change)


def remove(ids: DataFrame, path: str) -> int:
    """A version without these ids (column vec_id)."""
    spark = ids.sparkSession
    name = _write(ids.select("vec_id").where(F.col("vec_id").isNotNull()).distinct(), path, "gone")
    gone = spark.read.parquet(f"{path}/gone/{name}")

    def change(m: dict) -> dict:
        hit = _live(spark, path, m).select("vec_id").join(gone, "vec_id", "left_semi").count()
        return {**m, "gone": [*m["gone"], [m["version"] + 1, name]], "total": m["total"] - hit}
    return _changed(spark, path, change)


def compact(spark: SparkSession, path: str) -> int:
    """A version with the same rows in files of its own and no tombstones. It counts as
    one change; if another writer comes first, the rows are written again."""
    def change(m: dict) -> dict:
        return {**m, "data": [[m["version"] + 1, _write(_live(spark, path, m), path, "data")]], "gone": []}
    return _changed(spark, path, change)


def _schema(m: dict):
    from pyspark.sql.types import StructType
    return StructType.fromJson(json.loads(m["schema"]))


def _live(spark: SparkSession, path: str, m: dict) -> DataFrame:
    rows = None
    for number, name in m["data"]:
        part = spark.read.schema(_schema(m)).parquet(f"{path}/data/{name}").withColumn("_number", F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    gone = None
    for number, name in m["gone"]:
        part = spark.read.schema("vec_id bigint").parquet(f"{path}/gone/{name}").select(F.col("vec_id").alias("_gone"), F.lit(number).alias("_at"))
        gone = part if gone is None else gone.unionByName(part)
    if gone is not None:
        rows = rows.join(gone.groupBy("_gone").agg(F.max("_at").alias("_at")),
                         (F.col("vec_id") == F.col("_gone")) & (F.col("_at") > F.col("_number")), "left_anti")
    return rows.drop("_number")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The live rows of a version (by default the latest one), lazily; later changes
    do not touch it."""
    return _live(spark, path, manifest(spark, path, version))


def stats(spark: SparkSession, path: str) -> DataFrame:
    """``(version, total_vectors, dimension, data_files, tombstone_files)`` per version, from the manifests."""
    rows = [(m["version"], m["total"], m["dim"], len(m["data"]), len(m["gone"]))
            for m in (manifest(spark, path, v) for v in versions(spark, path))]
    return spark.createDataFrame(rows, "version int, total_vectors bigint, dimension int, data_files int, tombstone_files int")
