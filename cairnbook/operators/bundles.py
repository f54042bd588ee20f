"""Bundles that carry a store to a replica, and the account of the files that hold its evidence.

A manifest's digest is a tree: leaves are groups of blob hashes by their first digits, a node is the digest of the nodes
below it. Two copies are compared from the root: only below nodes that differ are rows compared, so a copy that lacks a
few blobs is found by a few rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.functions.lineage import stored
from cairnbook.operators.replication import blob_plan, refusals

#: Hex digits of the leaves of a tree; about 4096 blobs a leaf at 268 million blobs. Both sides must use the same.
LEAF_DIGITS = 4
#: First digits of a file's name that name its folder: 4096 folders, about 65,000 files in each at 268 million blobs.
FOLDER_DIGITS = 3
_FRAGMENT = r"^([0-9a-f]{64})\.tmp-"


def _digest(members: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(members)), "\n"), 256)


def digest_tree(blobs: DataFrame, digits: int = LEAF_DIGITS) -> DataFrame:
    """blobs: content_hash, bytes. Rows (level, prefix, n, bytes, digest): level 2 are leaves, 1 groups of leaves by two
    digits, 0 the root. Repeated blobs count once. An empty store has no rows."""
    one = blobs.groupBy("content_hash").agg(F.max("bytes").alias("bytes"))
    leaves = one.groupBy(F.substring("content_hash", 1, digits).alias("prefix")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), _digest(F.col("content_hash")).alias("digest"))
    below = F.concat_ws(":", "prefix", "digest")
    branches = leaves.groupBy(F.substring("prefix", 1, 2).alias("prefix")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), _digest(below).alias("digest"))
    root = branches.groupBy(F.lit("").alias("prefix")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), _digest(below).alias("digest"))
    out = None
    for level, rows in enumerate((root, branches, leaves)):
        rows = rows.select(F.lit(level).alias("level"), "prefix", "n", "bytes", "digest")
        out = rows if out is None else out.unionByName(rows)
    return out


def differing_leaves(here: DataFrame, there: DataFrame) -> DataFrame:
    """prefix of the leaves in which two trees differ; leaves are compared only below branches that differ."""
    side = lambda tree, level: tree.filter(F.col("level") == level).select("prefix", "digest")

    def differ(a: DataFrame, b: DataFrame) -> DataFrame:
        met = a.join(b.withColumnRenamed("digest", "_d"), "prefix", "full_outer")
        return met.filter(~F.col("digest").eqNullSafe(F.col("_d"))).select("prefix")

    open_ = differ(side(here, 1), side(there, 1)).withColumnRenamed("prefix", "_b")
    below = lambda tree: side(tree, 2).join(open_, F.substring("prefix", 1, 2) == F.col("_b"), "left_semi")
    return differ(below(here), below(there))


def manifest(objects: DataFrame) -> DataFrame:
    """One row: lineage (uuid of the object with the least number), high_water, n_objects. An empty store has nulls."""
    number = F.substring_index("object_id", "-", -1).cast("long")
    return objects.agg(F.min_by("uuid", number).alias("lineage"), F.max(number).alias("high_water"), F.count("*").alias("n_objects"))


def export_bundle(objects: DataFrame, blobs: DataFrame, path: str, remote_objects: DataFrame | None = None, remote_blobs: DataFrame | None = None, evidence: bool = True) -> DataFrame:
    """objects: object_id, uuid, content_hash, ... blobs: content_hash, content, bytes. Writes objects, manifest, tree and
    the blobs that the remote lacks (none with evidence=False) below a new path; returns refusals, and writes nothing if
    there are any: the remote is another store's, or ahead."""
    here = manifest(objects)
    if remote_objects is not None:
        refused = refusals(here, manifest(remote_objects))
        if not refused.isEmpty():
            return refused
    send = blobs
    if remote_blobs is not None:
        lacking = blob_plan(blobs, remote_blobs).filter("action = 'send'").select("content_hash")
        send = blobs.join(lacking, "content_hash", "left_semi")
    objects.write.parquet(f"{path}/objects")
    (send if evidence else send.limit(0)).dropDuplicates(["content_hash"]).write.parquet(f"{path}/blobs")
    digest_tree(blobs).coalesce(1).write.parquet(f"{path}/tree")
    here.write.parquet(f"{path}/manifest")  # last: a bundle without it isn't whole
    return objects.sparkSession.createDataFrame([], "refusal string")


def check_bundle(spark: SparkSession, path: str, objects: DataFrame | None = None, blobs: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Everything that stands against applying a bundle to a store (objects, blobs; none: a new replica): refusal, n. All
    blobs are hashed again on the executors; every blob that an incoming object names must be in the bundle or here; the
    store's tree, after the bundle, must have the digest that the sender's had."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    sent = read("blobs")
    hashed = sent.select("content_hash", "bytes", (F.sha2("content", 256) == F.col("content_hash")).alias("ok"))
    have = hashed.filter("ok").select("content_hash", "bytes")
    if blobs is not None:
        have = have.unionByName(blobs.select("content_hash", "bytes"))
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("refusal"), "n")
    wanted = read("objects").filter("content_hash is not null").select("content_hash").distinct()
    out = count(hashed.filter("not coalesce(ok, false)"), "corrupt blob")
    out = out.unionByName(count(wanted.join(have.select("content_hash"), "content_hash", "left_anti"), "missing blob"))
    out = out.unionByName(count(differing_leaves(read("tree"), digest_tree(have.join(wanted, "content_hash", "left_semi"))), "leaf differs"))
    if objects is not None:
        gates = refusals(read("manifest").select("lineage", "high_water"), manifest(objects).select("lineage", "high_water"), force)
        gates = gates.withColumn("refusal", F.when(F.col("refusal") == "remote is ahead", "this store is ahead").otherwise(F.col("refusal")))
        out = out.unionByName(gates.groupBy("refusal").agg(F.count("*").alias("n")))
    return out.filter("n > 0")


def apply_bundle(spark: SparkSession, path: str, objects: DataFrame | None = None, blobs: DataFrame | None = None, force: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(refusals, objects, blobs) after the bundle. With refusals nothing changes; blobs are only ever added."""
    against = check_bundle(spark, path, objects, blobs, force)
    if not against.isEmpty():
        return against, objects, blobs
    sent = spark.read.parquet(f"{path}/blobs")
    if blobs is not None:
        sent = blobs.unionByName(sent.join(blobs.select("content_hash"), "content_hash", "left_anti").select(*blobs.columns))
    return against, spark.read.parquet(f"{path}/objects"), sent


def _full_url(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark takes it to have."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _at(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a full URL and the path there. Spark's URLs of local files have no escapes."""
    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(url)


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of that name."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores by number: what a file costs doesn't follow its bytes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def write_files(files: DataFrame, path: str) -> None:
    """files: name, content; rows of one name have one content. One file per name below a path, in a folder of the first digits
    of its name (abc/abcd...; signs that are neither letters nor digits as -). Each task writes its rows (`dealt` spreads
    them) beside the path, and moves a file to its place when it is whole: what an attempt that was stopped leaves is never
    below the path, and one that is made again moves equal bytes to the same place."""
    url = _full_url(files.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _at(url)
        begun, folders, n = f"{root}-begun/{uuid.uuid4().hex}", set(), 0
        for folder in (root, f"{root}-begun"):
            system.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                name = name.as_py()
                folder = f"{root}/{re.sub('[^0-9A-Za-z]', '-', name[:FOLDER_DIGITS])}"
                if folder not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                with system.open_output_stream(begun, compression=None) as out:
                    out.write(content.as_buffer())
                system.move(begun, f"{folder}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content and name of every file below a folder, empty ones too; a file that Spark wrote under name=...
    bears that name. Tasks list the folders, a level at a time, and read the files, so the list is nowhere whole. What
    Spark's readers take for hidden is passed over."""
    url = _full_url(spark, path)
    root = _at(url)[1]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _at(url)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = [x for x in system.get_file_info(fs.FileSelector(folder)) if not _hidden(x.base_name)]
                columns = [x.path for x in found], [x.size for x in found], [x.type == fs.FileType.Directory for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["path", "length", "folder"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _at(url)

        def rows(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([len(c) for _, c in held], pa.int64()), pa.array([c for _, c in held], pa.binary())], names=["path", "length", "content"])

        for batch in batches:
            held, size = [], 0
            for one in batch.column("path").to_pylist():
                with system.open_input_file(one) as source:
                    held.append((one, source.read()))
                size += len(held[-1][1])
                if size > 4 << 20:
                    yield rows(held)
                    held, size = [], 0
            yield rows(held)

    folders, files = spark.range(0, 1, 1, 1).select(F.lit(root).alias("path")), None
    while True:
        level = stored(folders.mapInArrow(entries, "path string, length long, folder boolean"))
        here = level.filter("not folder").select("path")
        files = here if files is None else files.unionByName(here)
        folders = level.filter("folder").select("path")
        if folders.isEmpty():
            break
        folders = dealt(folders, "path")
    found = dealt(files, "path").mapInArrow(contents, "path string, length long, content binary")
    whole = F.col("path") if url.startswith("file:") else F.concat(F.lit(url.removesuffix(root)), "path")
    last = F.regexp_replace(F.substring_index("path", "/", -1), r"\.txt$", "")
    return found.select(whole.alias("path"), "length", "content", F.coalesce(F.nullif(F.regexp_extract("path", r"/name=([^/]+)/[^/]*$", 1), F.lit("")), last).alias("name"))


def account_for_files(listing: DataFrame, blobs: DataFrame) -> DataFrame:
    """listing: name, length, content. blobs: content_hash. One row per file and one per blob without a file: name, state,
    prunable. A file is ok or corrupt (by a new hash of its bytes) if a blob has its name; `partial` if it is a fragment
    '<hash>.tmp-...' of an interrupted write; else foreign. A blob without a file is missing. A fragment may go only if
    the blob that it was becoming is registered, is there, and hashes to its name. Each file is read once."""
    f = stored(listing.select("name", (F.sha2("content", 256) == F.col("name")).alias("_same"), F.nullif(F.regexp_extract("name", _FRAGMENT, 1), F.lit("")).alias("_of")))
    known = blobs.select(F.col("content_hash").alias("_of")).distinct().withColumn("_known", F.lit(True))
    keyed = f.withColumn("_of", F.coalesce("_of", "name")).withColumn("_whole", F.col("_of") == F.col("name"))
    good = keyed.filter(F.col("_whole") & F.col("_same")).select("_of").distinct().withColumn("_good", F.lit(True))
    met = keyed.join(known, "_of", "full_outer").join(good, "_of", "left")
    state = (
        F.when(F.col("name").isNull(), "missing").when(~F.col("_whole"), "partial").when(F.col("_known").isNull(), "foreign").when(F.col("_same"), "ok").otherwise("corrupt")
    )
    rows = met.select(F.coalesce("name", "_of").alias("name"), state.alias("state"), (~F.coalesce("_whole", F.lit(True)) & F.coalesce(F.col("_known") & F.col("_good"), F.lit(False))).alias("prunable"), "_of")
    # a blob of which only a fragment is there is missing too
    torn = keyed.groupBy("_of").agg(F.bool_or("_whole").alias("_any")).filter("not _any").join(known, "_of").select(F.col("_of").alias("name"), F.lit("missing").alias("state"), F.lit(False).alias("prunable"))
    return rows.drop("_of").unionByName(torn)
