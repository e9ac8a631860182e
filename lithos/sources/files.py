"""Discovery and decoding of asset files.

Spark's own file source drops names that begin with "." or "_", which are ordinary files
here, so listing is a Python data source.  It is planned lazily: the driver looks into the
topmost folders only, until there are enough parts for many tasks, and a folder with very
many files is shared by several.  Unreadable folders are skipped and reported.

Contents are read afterwards, of assets and archives alone, dealt over tasks by bytes.
"""

from __future__ import annotations

import io
import os
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lithos.functions.names import PRIORITY
from lithos.sources.binary import Corrupt
from lithos.sources.metadata import decode
from lithos.storage import settled

#: Extensions by what is done with the file, and the accepted sizes.
ASSETS = {*PRIORITY, "pfb", "pfa"}
ARCHIVES = {"zip", "rar", "7z", "exe"}
LEAST, MOST = 12, 512 << 20

ENTRY = (
    "display_name string, family string, typo_family string, style string, typo_subfamily string, full_name string, ps_name string, version string, "
    "glyph_count int, outline string, ext string, is_variable boolean, metadata_score int, license string, file_size bigint, crc32 bigint, sha256 string, "
    "coverage array<struct<start:int,end:int>>, axes array<struct<tag:string,min:float,default:float,max:float>>, features array<string>, "
    "path string, status string, error string"
)


#: Parts that the listing is planned for, files of one folder a part lists, and bytes a task reads, about.
PARTS, SHARE, TASK_BYTES = 256, 10_000, 256 << 20
#: Bytes of content in one batch, about.
BATCH_BYTES = 64 << 20


class TreeSource(DataSource):
    """spark.read.format("asset_tree").option("path", root).load(): path and length of all files below.

    ``option("paths", "a\nb")`` reads several roots as one.  Unreadable folders and files
    become rows with an ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return "asset_tree"

    def schema(self) -> str:
        return "path string, length bigint, error string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader([p for p in (self.options.get("paths") or self.options.get("path") or "").split("\n") if p])


class Part(InputPartition):
    """A file, a folder with all below it, or a share of the files of one folder."""

    def __init__(self, top: str, deep: bool = True, share: int = 0, of: int = 1):
        self.top, self.deep, self.share, self.of = top, deep, share, of


def _folder(entry: os.DirEntry) -> bool:
    return entry.is_dir(follow_symlinks=False)


def _file(entry: os.DirEntry) -> bool:
    return not (_folder(entry) or entry.is_symlink() and os.path.isdir(entry.path))  # links to folders are not followed


class TreeReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = [r.removeprefix("file://") for r in roots]

    def partitions(self) -> list[InputPartition]:
        """Folders from the top, opened until there are PARTS; what is not opened is listed by the tasks."""
        found, closed = [], list(self.roots)
        while closed and len(found) + len(closed) < PARTS:
            top = closed.pop(0)
            try:
                entries = list(os.scandir(top)) if os.path.isdir(top) else None
            except OSError:
                entries = None
            if entries is None:
                found.append(Part(top))
                continue
            shares = -(-sum(map(_file, entries)) // SHARE)
            found += [Part(top, False, k, shares) for k in range(shares)]
            closed += sorted(e.path for e in entries if _folder(e))
        return found + [Part(top) for top in closed]

    def read(self, partition: Part) -> Iterator[tuple]:
        failed: list[OSError] = []
        top = partition.top
        if not os.path.isdir(top):
            paths = iter([top])
        elif partition.deep:
            paths = (os.path.join(d, n) for d, _, names in os.walk(top, onerror=failed.append) for n in sorted(names))
        else:
            own = lambda name: zlib.crc32(os.fsencode(name)) % partition.of == partition.share
            paths = iter(sorted(e.path for e in os.scandir(top) if own(e.name) and _file(e)))
        for path in paths:
            try:
                yield path, os.path.getsize(path), None
            except OSError as e:
                yield path, None, str(e)
        for e in failed:
            yield e.filename, None, str(e)


def list_trees(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, length and error of all files below the roots."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("asset_tree").option("paths", "\n".join(roots)).load()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length, error) with content, in batches of a bounded size."""
    names, rows, held = ["path", "length", "error", "content"], [], 0

    def batch() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for b in batches:
        for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
            raw, error = None, None
            try:
                if length is not None and length <= MOST:
                    with open(path, "rb") as f:
                        raw = f.read()
            except OSError as e:
                error = str(e)
            rows.append((path, length, error, raw))
            held += len(raw or b"")
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def read_trees(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, length, error and, of assets and archives, content of all files below the roots."""
    listed = settled(list_trees(spark, roots))
    wanted = F.col("route").isin("asset", "archive")
    told = routed(listed)
    total = told.filter(wanted).agg(F.sum("length")).first()[0] or 0
    read = told.filter(wanted).select("path", "length", "error").repartition(1 + total // TASK_BYTES, F.xxhash64("path"))
    read = read.mapInArrow(_contents, "path string, length bigint, error string, content binary")
    return read.unionByName(told.filter(~wanted).select("path", "length", "error", F.lit(None).cast("binary").alias("content")))


def routed(files: DataFrame) -> DataFrame:
    """Adds ``route``: asset, archive, sidecar, error or ignore."""
    base = F.regexp_extract("path", r"([^/\\]*)$", 1)
    ext = F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1))
    route = F.when(F.startswith(base, F.lit("._")), "sidecar").when(ext.isin(*ASSETS), "asset").when(ext.isin(*ARCHIVES), "archive").otherwise("ignore")
    if "error" in files.columns:
        route = F.when(F.col("error").isNotNull(), "error").otherwise(route)
    return files.withColumn("ext", ext).withColumn("route", route)


def _safe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return ".." not in parts and not name.startswith(("/", "\\")) and ":" not in parts[0]


def members(path: str, ext: str, content: bytes) -> Iterator[tuple[str, str, bytes | None, str | None]]:
    """(path!member, ext, content, error) of the assets in an archive; a self-extracting one is read, never run."""
    if ext in ("rar", "7z"):
        yield path, ext, None, f"no reader for .{ext} archives"
        return
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                base = info.filename.replace("\\", "/").rpartition("/")[2]
                kind = base.rpartition(".")[2].lower() if "." in base else ""
                if info.is_dir() or kind not in ASSETS or base.startswith("._"):
                    continue
                at = f"{path}!{info.filename}"
                if not _safe(info.filename):
                    yield at, kind, None, "path leaves the archive"
                elif info.file_size > MOST:
                    yield at, kind, None, "size out of bounds"
                else:
                    try:
                        yield at, kind, z.read(info), None
                    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as e:
                        yield at, kind, None, f"archive member: {e}"
    except zipfile.BadZipFile as e:
        yield path, ext, None, f"archive: {e}"


_NAMES = [c.split(" ", 1)[0] for c in ENTRY.replace("struct<start:int,end:int>", "s").replace("struct<tag:string,min:float,default:float,max:float>", "s").split(", ")]


def entry_row(path: str, ext: str, content: bytes | None, error: str | None = None) -> dict:
    """One decoded row; whatever is wrong with a file ends up in ``error``, never in an exception."""
    import hashlib

    row = dict.fromkeys(_NAMES) | {"path": path, "ext": ext, "status": "rejected", "error": error}
    if error is None and content is None:
        row["error"] = "no content"
    if row["error"] is None and not LEAST <= len(content) <= MOST:
        row["error"] = "size out of bounds"
    if row["error"]:
        return row
    row |= {"file_size": len(content), "crc32": zlib.crc32(content), "sha256": hashlib.sha256(content).hexdigest()}
    try:
        row["ext"], record = decode(content, ext)
    except Corrupt as e:
        return row | {"error": str(e)}
    except Exception as e:  # a malformed file must not end the job
        return row | {"error": f"malformed: {type(e).__name__}"}
    spans = [{"start": a, "end": b} for a, b in record.pop("coverage")]
    axes = [dict(zip(("tag", "min", "default", "max"), x, strict=True)) for x in record.pop("axes")]
    return row | record | {"coverage": spans, "axes": axes, "status": "ok", "error": None}


def decoded(files: DataFrame) -> DataFrame:
    """Files (path, ext, route, content) to entry rows, archives opened; content goes no further than this stage."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ENTRY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                path, ext, route, content = (batch.column(c)[k].as_py() for c in ("path", "ext", "route", "content"))
                if route == "archive":
                    rows += [entry_row(*m) for m in members(path, ext, content or b"")]
                else:
                    rows.append(entry_row(path, ext, content))
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return files.filter(F.col("route").isin("asset", "archive")).select("path", "ext", "route", "content").mapInArrow(run, ENTRY)
