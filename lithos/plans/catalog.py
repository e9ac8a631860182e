"""The catalog: additive import, atomic publishing, validation, export and repair plans."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lithos.functions.intervals import covered
from lithos.functions.names import effective_style, format_priority, group_key, marker_crc, vault_path, version_number
from lithos.operators.dedup import exact_groups, match_existing, unmatched
from lithos.operators.placement import repair_plan, resolve_collisions
from lithos.operators.selection import additive_selection
from lithos.operators.skew import to_group, with_group
from lithos.storage import settled

VERSION = 1
POINTER = "_CURRENT-"
#: Older pointers that stay, for readers that have just listed them.
KEPT = 3


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_generation(entries: DataFrame, root: str) -> str:
    """Writes a generation next to those that are there; nobody sees it before point_to().

    Entries are in catalog order, by name and style without regard to case, across and
    within files, so that searches by name prefix prune files and row groups.
    """
    name = f"v{VERSION}-{uuid.uuid4().hex}"
    order = [F.upper("display_name"), F.upper(effective_style(F.col("typo_subfamily"), F.col("style")))]
    entries.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{root}/{name}")
    return name


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, path) of the pointers, the newest first."""
    jvm, fs = _filesystem(spark, root)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}*"))
    names = [s.getPath().getName() for s in found or ()]
    return sorted(((int(n.removeprefix(POINTER)), f"{root}/{n}") for n in names if n.removeprefix(POINTER).isdigit()), reverse=True)


def point_to(spark: SparkSession, root: str, name: str) -> None:
    """Makes a written generation the current one: a pointer of the next number appears by one rename.

    Nothing is removed before it is there, so a run that dies at any point leaves the old
    catalog or the new one.  Of two writers of one number the second takes the next.
    """
    jvm, fs = _filesystem(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    draft = path(f"{root}/.{name}.pointer")
    out = fs.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    old = _pointers(spark, root)
    number = old[0][0] + 1 if old else 1
    while fs.exists(path(f"{root}/{POINTER}{number:012d}")) or not fs.rename(draft, path(f"{root}/{POINTER}{number:012d}")):
        if not fs.exists(draft):
            raise OSError(f"cannot publish {name} in {root}")
        number += 1
    for _, at in old[KEPT:]:
        fs.delete(path(at), False)


def publish(entries: DataFrame, root: str) -> str:
    """Writes a new generation and then points to it; readers see the old catalog or the new one, never a part."""
    name = write_generation(entries, root)
    point_to(entries.sparkSession, root, name)
    return name


def load(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete generation, or None where none was ever published; another version asks for a rebuild."""
    jvm, fs = _filesystem(spark, root)
    pointers = _pointers(spark, root)
    for _, at in pointers:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(at))
        name = bytes(stream.readAllBytes()).decode()
        stream.close()
        if name and not name.startswith(f"v{VERSION}-"):
            raise ValueError(f"catalog {name} is of another version; rebuild it")
        if name and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS")):
            return spark.read.parquet(f"{root}/{name}")
    if pointers:
        raise OSError(f"no pointer of {root} leads to a complete catalog")
    return None


def heavy(catalog: DataFrame, key: Column) -> DataFrame:
    """The large columns of chosen entries; nothing else of the catalog is read."""
    return catalog.filter(key).select("sha256", "coverage", "axes", "features", "original_paths")


def validate(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Counts and bytes of the catalog against a listing of the vault, and whether they agree."""
    total = lambda df, p: df.agg(F.count(F.lit(1)).alias(f"{p}_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias(f"{p}_bytes"))
    both = total(catalog, "catalog").join(total(listing, "disk"))  # one row each
    return both.withColumn("valid", (F.col("catalog_files") == F.col("disk_files")) & (F.col("catalog_bytes") == F.col("disk_bytes")))


def criteria(entries: DataFrame) -> DataFrame:
    """Adds the group key and what variants are ranked by."""
    style = effective_style(F.col("typo_subfamily"), F.col("style"))
    return entries.withColumns(
        {
            "group_key": group_key(F.col("display_name"), style),
            "prio": format_priority(F.col("ext")),
            "version_no": version_number(F.col("version")),
            "coverage_n": covered(F.coalesce("coverage", F.array().cast("array<struct<start:int,end:int>>"))),
        }
    )


def checksum_mark() -> Column:
    """What tells equal names apart."""
    return F.concat(F.lit("_c"), F.lpad(F.hex("crc32"), 8, "0"))


def plan_import(decoded: DataFrame, catalog: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(catalog after the import, accounting by outcome) of newly decoded entries.

    Every decoded file ends in exactly one outcome: rejected, duplicate (of a new file or
    of the catalog), not the best version, or added; the counts add up to the input.
    """
    decoded = settled(decoded)  # files are decoded once, whatever follows
    keys = ["file_size", "crc32", "sha256"]
    ok = decoded.filter("status = 'ok'")
    groups = exact_groups(ok, keys, "path").withColumnRenamed("paths", "original_paths")
    records = ok.drop("status", "error").join(groups.select(*keys, F.col("representative").alias("path"), "original_paths"), [*keys, "path"])
    records = settled(records.dropDuplicates(keys))
    if catalog is None:
        catalog = records.withColumn("vault_path", F.lit("")).limit(0)
    known = match_existing(records.select(*keys, "original_paths"), catalog, keys, "vault_path").select(*keys, F.col("original_paths").alias("more"))
    fresh = unmatched(records, catalog, keys)

    shape = [c for c in records.columns if c != "path"]
    old = catalog.withColumn("path", F.col("vault_path")).withColumn("is_existing", F.lit(True))
    pool = old.select(*shape, "path", "vault_path", "is_existing").unionByName(fresh.select(*shape, "path").withColumn("vault_path", F.lit("")).withColumn("is_existing", F.lit(False)))
    ranked = criteria(pool).withColumn("glyphs", F.col("glyph_count")).withColumn("metadata", F.col("metadata_score")).drop("version").withColumnRenamed("version_no", "version")
    chosen = additive_selection(ranked.select("group_key", "is_existing", "prio", "version", "glyphs", "coverage_n", "metadata", "is_variable", "crc32", "path", "sha256", "original_paths"), ["group_key"])
    chosen = settled(chosen)
    lost = chosen.filter("not kept").select("group_key", F.col("winner").alias("path"), F.explode("original_paths").alias("p")).groupBy("group_key", "path").agg(F.collect_set("p").alias("lost"))
    kept = chosen.filter("kept").join(lost, ["group_key", "path"], "left").select("sha256", "lost")

    body = pool.join(kept, "sha256").join(known.drop("file_size", "crc32"), "sha256", "left")
    none = F.array().cast("array<string>")
    paths = F.array_sort(F.array_union(F.array_union("original_paths", F.coalesce("more", none)), F.coalesce("lost", none)))
    body = body.withColumn("original_paths", paths).drop("more", "lost")
    style = effective_style(F.col("typo_subfamily"), F.col("style"))
    base = vault_path(F.col("display_name"), style, F.col("version"), F.col("glyph_count"), F.col("ext"))
    # Old entries keep their paths; new ones give way to them.
    placed = settled(body).withColumn("_base", F.when(F.col("is_existing"), F.col("vault_path")).otherwise(base)).withColumn("_order", F.concat(F.when(F.col("is_existing"), "0").otherwise("1"), F.col("path")))
    named = resolve_collisions(placed, "_base", checksum_mark(), "_order").withColumn("vault_path", F.col("target"))
    after = named.select(*shape, "path", "vault_path")

    duplicates = ok.agg(F.count(F.lit(1)).alias("n")).join(records.agg(F.count(F.lit(1)).alias("m"))).select(F.lit("duplicate of new").alias("outcome"), (F.col("n") - F.col("m")).alias("n"))
    counted = decoded.filter("status <> 'ok'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("outcome"), "n")
    counted = counted.unionByName(duplicates)
    counted = counted.unionByName(known.agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate of catalog").alias("outcome"), "n"))
    fate = chosen.filter("not is_existing").agg(F.count(F.when(F.col("kept"), 1)).alias("a"), F.count(F.when(~F.col("kept"), 1)).alias("b"))
    counted = counted.unionByName(fate.select(F.lit("added").alias("outcome"), F.col("a").alias("n"))).unionByName(fate.select(F.lit("not the best version").alias("outcome"), F.col("b").alias("n")))
    return after, counted


def plan_repair(files: DataFrame) -> DataFrame:
    """delete, move or keep for each decoded file of a vault, and the target; distinct assets are never removed."""
    style = effective_style(F.col("typo_subfamily"), F.col("style"))
    base = vault_path(F.col("display_name"), style, F.col("version"), F.col("glyph_count"), F.col("ext"))
    firsts = with_group(files, ["sha256"], F.col("path"), {"_least": ("min", "path")}).filter("path = _least").drop("_least")
    # In the order of their paths without regard to case.
    named = resolve_collisions(firsts.withColumns({"_base": base, "_order": F.concat(F.upper("path"), F.lit("\0"), F.col("path"))}), "_base", checksum_mark(), "_order").select("sha256", "target")
    return repair_plan(to_group(files, named, ["sha256"], F.col("path")), "path", "sha256", "target")


def export_plan(entries: DataFrame, folder: str) -> DataFrame:
    """(src, dst) of entries to copy into a folder; names that would repeat get a checksum."""
    base = F.regexp_extract("vault_path", r"([^/]+)$", 1)
    named = resolve_collisions(entries.withColumn("_base", base), "_base", checksum_mark(), "vault_path")
    return named.select(F.col("vault_path").alias("src"), F.concat(F.lit(folder.rstrip("/") + "/"), F.col("target")).alias("dst"))


def write_rejects(decoded: DataFrame, path: str) -> None:
    """Rejected files as tab-separated lines: time, stage, path, message, with line breaks blanked."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n\t]+", " ")
    rows = decoded.filter("status <> 'ok'").select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("decode").alias("stage"), flat(F.col("path")).alias("path"), flat(F.col("error")).alias("message"))
    rows.write.mode("append").csv(path, sep="\t")


def quarantine_plan(decoded: DataFrame, folder: str) -> DataFrame:
    """(src, dst) of unreadable files; a checksum of the source path keeps equal names apart."""
    whole = decoded.filter("status <> 'ok'").filter(~F.contains("path", F.lit("!")))
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    return whole.select(F.col("path").alias("src"), F.concat(F.lit(folder.rstrip("/") + "/"), F.lpad(F.hex(F.crc32(F.col("path").cast("binary"))), 8, "0"), F.lit("_"), base).alias("dst"))


def installed_listing(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checksums named by markers, size and checksum of all others) of asset files in system folders."""
    own = files.filter("route = 'asset'").withColumn("marker", marker_crc(F.col("path")))
    raw = F.col("content")
    return own.filter("marker is not null").select(F.col("marker").alias("crc32")), own.filter("marker is null").select(F.octet_length(raw).cast("bigint").alias("file_size"), F.crc32(raw).alias("crc32"))


def _checksum(path: str) -> int:
    import zlib

    crc = 0
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            crc = zlib.crc32(part, crc)
    return crc


def _carried_out(plan: DataFrame, act) -> DataFrame:
    """act(row) on the executors for each row; (its columns, outcome)."""

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    out.append(act(row))
                except OSError as e:
                    out.append(f"failed: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "outcome"])

    return plan.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plan.schema.fields] + ["outcome string"]))


def copy_files(plan: DataFrame) -> DataFrame:
    """Carries out a (src, dst) plan on the executors, by way of a temporary name; (src, dst, outcome) rows.

    Existing targets of the same size and checksum are left alone, so a repeated or retried
    run is safe; others are in the way and stay as they are.
    """

    def act(row) -> str:
        src, dst = row["src"], row["dst"]
        if os.path.exists(dst):
            same = os.path.getsize(dst) == os.path.getsize(src) and _checksum(dst) == _checksum(src)
            return "present" if same else "other file in the way"
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        draft = f"{dst}.{uuid.uuid4().hex}.part"
        shutil.copyfile(src, draft)
        os.replace(draft, dst)
        return "copied"

    return _carried_out(plan.select("src", "dst"), act)


def apply_repair(plan: DataFrame, root: str, staging: str) -> DataFrame:
    """Carries out a repair plan (path, action, target relative to root): (path, action, outcome) rows.

    Duplicates are deleted.  Files move in two phases by way of a staging folder, so that
    occupied targets and swaps cannot clash; a file whose target is taken by then goes back.
    Folders of the root that are left empty go.  What was done before is done again without
    harm: a staged file is found under the name that its path gives it.
    """
    place = lambda path: os.path.join(staging, hashlib.sha256(path.encode()).hexdigest())

    def leave(row) -> str:
        if row["action"] == "keep":
            return "kept"
        if row["action"] == "delete":
            if os.path.exists(row["path"]):
                os.remove(row["path"])
            return "deleted"
        os.makedirs(staging, exist_ok=True)
        if os.path.exists(row["path"]):
            os.replace(row["path"], place(row["path"]))
        return "staged"

    def arrive(row) -> str:
        if row["left"] != "staged":
            return row["left"]
        target, at = os.path.join(root, row["target"]), place(row["path"])
        if not os.path.exists(at):
            return "moved" if os.path.exists(target) else "failed: neither staged nor moved"
        if os.path.exists(target):
            os.replace(at, row["path"])
            return "failed: the target is taken"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.replace(at, target)
        return "moved"

    left = settled(_carried_out(plan.select("path", "action", "target"), leave).withColumnRenamed("outcome", "left"))
    done = settled(_carried_out(left, arrive))
    for folder, _, _ in sorted(os.walk(root, topdown=False), reverse=True):
        if folder != root and not os.listdir(folder):
            os.rmdir(folder)
    return done.select("path", "action", "outcome")


def counted(decoded: DataFrame) -> tuple[DataFrame, Observation]:
    """decoded with live counters: processed, errors and bytes are there once an action on it has run."""
    seen = Observation()
    bad = F.col("status") != "ok"
    return decoded.observe(seen, F.count(F.lit(1)).alias("processed"), F.count(F.when(bad, 1)).alias("errors"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")), seen
