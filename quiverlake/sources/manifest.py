"""Versions of an index: immutable files and a manifest for each version.

    path/data/<write>/cluster_id=<c>/...   what one write stored; never changed
    path/versions/<n>.json                 for each cluster the pieces that hold it in version n:
                                           the write, its first position, how many vectors

A write stores its files first and then adds the next version, which only succeeds if that
version isn't there yet (compare and swap). A writer that loses reads the newer version and
applies its change to it, so changes of other clusters are kept and its files aren't written
again. A reader takes a snapshot, a version, and reads the files that it names: replacing a
cluster meanwhile doesn't touch them. vacuum() removes what the newest versions don't name.

append() adds a piece to each cluster that new rows belong to. Their positions (vector_id)
are stored from 0 on; where the piece begins is what the manifest counts, so it is only
settled by the commit, and adding costs nothing for the rows that are there. A reader adds
the two. compact() folds clusters of several pieces into one, leaving what was appended
since in its place behind it.

Defined results: without versions there are no rows; a cluster that a replacing write has no
rows of is left as it is, unless it is named as replaced; writing no rows adds a version.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST_TRIES = 100


Piece = tuple[str, int, int]  # a write, the position of its first vector, and how many


@dataclass(frozen=True)
class Snapshot:
    """A version: the pieces of each cluster in the order of their positions."""

    number: int = 0
    clusters: dict[int, list[Piece]] = field(default_factory=dict)

    def sizes(self) -> dict[int, int]:
        return {c: p[-1][1] + p[-1][2] for c, p in self.clusters.items()}


class Conflict(RuntimeError):
    """Others kept adding versions."""


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _list(spark: SparkSession, path: str) -> list[str]:
    files, at = _hadoop(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions, ascending."""
    return sorted(int(m[1]) for name in _list(spark, f"{path}/versions") if (m := re.fullmatch(r"(\d+)\.json", name)))


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot:
    """A version, by default the newest."""
    found = versions(spark, path) if number is None else [number]
    if not found:
        return Snapshot()
    files, at = _hadoop(spark, f"{path}/versions/{found[-1]:012d}.json")
    stream = files.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    content = json.loads(text)
    return Snapshot(content["version"], {int(c): [tuple(p) for p in pieces] for c, pieces in content["clusters"].items()})


def _add(spark: SparkSession, path: str, new: Snapshot) -> bool:
    """Store a version whole, or not at all if there is one of its number."""
    files, folder = _hadoop(spark, f"{path}/versions")
    files.mkdirs(folder)
    text = json.dumps({"version": new.number, "clusters": {str(c): p for c, p in sorted(new.clusters.items())}})
    name = f"{new.number:012d}.json"
    if folder.toUri().getScheme() in (None, "file"):  # a link to a whole file is made once or fails
        place = folder.toUri().getPath()
        made = f"{place}/_{uuid.uuid4().hex}"
        with open(made, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(made, f"{place}/{name}")
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(made)
    made, to = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, x) for x in (f"_{uuid.uuid4().hex}", name))
    out = files.create(made, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not files.exists(to) and files.rename(made, to):  # a distributed file system's rename doesn't replace a file
        return True
    files.delete(made, False)
    return False


def commit(spark: SparkSession, path: str, change: Callable[[dict[int, list[Piece]]], dict[int, list[Piece]]]) -> Snapshot:
    """Apply a change of the clusters' pieces to the newest version and add the result; against other writers, again and again."""
    for _ in range(MOST_TRIES):
        base = snapshot(spark, path)
        new = Snapshot(base.number + 1, change(dict(base.clusters)))
        if _add(spark, path, new):
            return new
    raise Conflict(f"{path}: {MOST_TRIES} versions were added by others")


def _store(rows: DataFrame, path: str) -> tuple[str, dict[int, int]]:
    """Store rows as one write; its name and how many rows it has of each cluster. A cluster may be dealt to any number of tasks."""
    spark, write = rows.sparkSession, uuid.uuid4().hex
    rows.write.mode("errorifexists").partitionBy("cluster_id").parquet(f"{path}/data/{write}")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/data/{write}")
    return write, {r.cluster_id: r.n for r in stored.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}  # a row for each cluster


def save(rows: DataFrame, path: str) -> Snapshot:
    """Replace everything by rows (cluster_id and others)."""
    write, sizes = _store(rows, path)
    return commit(rows.sparkSession, path, lambda _: {c: [(write, 0, n)] for c, n in sizes.items()})


def overwrite_clusters(rows: DataFrame, path: str, replaced: Iterable[int] = ()) -> Snapshot:
    """Replace the clusters that occur in rows; those of `replaced` that don't are emptied."""
    write, sizes = _store(rows, path)
    gone = set(replaced) - set(sizes)
    return commit(rows.sparkSession, path, lambda old: {c: p for c, p in old.items() if c not in gone} | {c: [(write, 0, n)] for c, n in sizes.items()})


def append(rows: DataFrame, path: str) -> Snapshot:
    """Add rows (cluster_id, vector_id from 0 in each cluster, and others) behind those that are there."""
    write, sizes = _store(rows, path)

    def change(old: dict[int, list[Piece]]) -> dict[int, list[Piece]]:
        counter = Snapshot(0, old).sizes()
        return old | {c: [*old.get(c, []), (write, counter.get(c, 0), n)] for c, n in sizes.items()}

    return commit(rows.sparkSession, path, change)


def compact(spark: SparkSession, path: str, schema: StructType | str, most: int = 1) -> Snapshot:
    """Fold the clusters that have more than `most` pieces into one piece each."""
    base = snapshot(spark, path)
    several = {c: p for c, p in base.clusters.items() if len(p) > most}
    if not several:
        return base
    write, sizes = _store(load(spark, path, schema, Snapshot(base.number, several)), path)

    def change(old: dict[int, list[Piece]]) -> dict[int, list[Piece]]:
        same = [c for c, p in several.items() if old.get(c, [])[: len(p)] == p]  # not replaced meanwhile
        return old | {c: [(write, 0, sizes[c]), *old[c][len(several[c]) :]] for c in same}

    return commit(spark, path, change)


def load(spark: SparkSession, path: str, schema: StructType | str, at: Snapshot | None = None) -> DataFrame:
    """The rows of a snapshot. Each write is one scan, filtered to the clusters that it still holds, so other folders aren't read."""
    at = at or snapshot(spark, path)
    by_write: dict[str, dict[int, int]] = {}
    for cluster, pieces in at.clusters.items():
        for write, start, _ in pieces:
            by_write.setdefault(write, {})[cluster] = start
    none = spark.createDataFrame([], schema)

    def part(write: str, starts: dict[int, int]) -> DataFrame:
        rows = spark.read.schema(schema).parquet(f"{path}/data/{write}").where(F.col("cluster_id").isin(list(starts)))
        if any(starts.values()):
            table = spark.createDataFrame(list(starts.items()), "cluster_id int, _start bigint")  # a row for each cluster
            rows = rows.join(F.broadcast(table), "cluster_id").withColumn("vector_id", F.col("vector_id") + F.col("_start"))
        return rows.select(none.columns)

    parts = [part(*x) for x in sorted(by_write.items())]
    return reduce(DataFrame.unionByName, parts, none) if len(parts) != 1 else parts[0]


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove all but the newest `keep` versions, and the writes that these don't name. Not to be run beside a writer."""
    found = versions(spark, path)
    used = {w for n in found[-keep:] for pieces in snapshot(spark, path, n).clusters.values() for w, *_ in pieces}
    for n in found[:-keep]:
        files, at = _hadoop(spark, f"{path}/versions/{n:012d}.json")
        files.delete(at, False)
    gone = sorted(set(_list(spark, f"{path}/data")) - used)
    for write in gone:
        files, at = _hadoop(spark, f"{path}/data/{write}")
        files.delete(at, True)
    return gone
