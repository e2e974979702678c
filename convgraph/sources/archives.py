"""Zip archives of JSON files as a Spark data source and sink.

``JsonArchives`` is a data source (format ``json_archives``).  Planning reads the
central directory of each archive and no member; a partition is a run of members
of one archive of about ``partitionBytes`` compressed bytes, or one larger
member, so one archive of many members uses many tasks.  A task opens the archive
at the members it was given and streams them: it holds one block of compressed
bytes, the record it is in and one batch of records.  Records leave as text and
are parsed by Spark with an explicit schema.

A member is a JSON array of records, or one record, or records one after the
other (JSON lines); a byte order mark is skipped.  A member that is none of this
fails with its name.  Members whose base name does not end in ``.json`` or is
``skip`` are not read.  Paths are files, folders (their ``*.zip``) or glob
patterns, local or of any file system that Arrow opens (hdfs, s3, gs).
"""
from __future__ import annotations

import codecs
import fnmatch
import json
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, origin_file string, record string"
#: Compressed bytes of a partition, bytes read at once, records and characters of a batch.
PARTITION_BYTES = 16 << 20
BLOCK_BYTES = 1 << 18
BATCH_RECORDS = 2000
BATCH_CHARS = 4 << 20


def file_system(path: str):
    """(file system, path in it)."""
    from pyarrow import fs
    path = re.sub(r"^file:/+", "/", path)
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]+://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def archives(path: str) -> list[str]:
    """Full paths of the archives that a path names, in order."""
    from pyarrow import fs
    system, inner = file_system(path)
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    if any(c in inner for c in "*?["):
        folder = re.split(r"[*?\[]", inner, maxsplit=1)[0].rsplit("/", 1)[0]
        found = system.get_file_info(fs.FileSelector(folder or "/", recursive=True))
        names = [f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.path, inner)]
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            names = [inner]
        else:
            found = system.get_file_info(fs.FileSelector(inner, recursive=True))
            names = [f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".zip")]
    return [prefix + n for n in sorted(names)]


def members(path: str, skip: str) -> list[tuple[str, int]]:
    """(name, compressed bytes) of the members to read, in archive order."""
    system, inner = file_system(path)
    with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
        return [(m.filename, m.compress_size) for m in z.infolist()
                if m.filename.endswith(".json") and m.filename.rsplit("/", 1)[-1] != skip]


def records(stream, name: str, block_bytes: int = BLOCK_BYTES):
    """The records of a member as JSON text, read block by block."""
    decoder, utf8 = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8-sig")()
    text, at, ended, in_array, seen, wanted = "", 0, False, False, False, block_bytes
    space = re.compile(r"[ \t\r\n]*")
    while True:
        at = space.match(text, at).end()
        if in_array and at < len(text) and text[at] in ",]":
            in_array = text[at] == ","
            at += 1
            continue
        if at < len(text) and text[at] == "[" and not seen:
            in_array = seen = True
            at += 1
            continue
        if at < len(text):
            try:
                value, end = decoder.raw_decode(text, at)
                # a record ends with a brace, so nothing that follows could belong to it
                if not isinstance(value, dict):
                    raise ValueError(f"{name}: a record is expected, not {text[at:at + 40]!r}")
                seen = True
                yield text[at:end]
                at, wanted = end, block_bytes
                continue
            except json.JSONDecodeError as e:
                if ended or text[at] != "{":
                    raise ValueError(f"{name}: no JSON records") from e
        elif ended:
            if in_array:
                raise ValueError(f"{name}: an array that does not end")
            return
        block = stream.read(wanted)
        # a record longer than a block is tried again only when its text has doubled
        wanted = max(block_bytes, len(text) - at)
        ended = not block
        text, at = text[at:] + utf8.decode(block, final=ended), 0


class Members(InputPartition):
    def __init__(self, path: str, names: list[str]):
        super().__init__(path)
        self.path, self.names = path, names


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.skip = options.get("skip", "statistics.json")
        self.target = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self):
        from concurrent.futures import ThreadPoolExecutor
        paths = archives(self.path)
        out = []
        with ThreadPoolExecutor(32) as pool:
            for path, found in zip(paths, pool.map(lambda p: members(p, self.skip), paths)):
                run, size = [], 0
                for name, compressed in found:
                    if run and size + compressed > self.target:
                        out.append(Members(path, run))
                        run, size = [], 0
                    run.append(name)
                    size += compressed
                if run:
                    out.append(Members(path, run))
        return out

    def read(self, partition):
        import pyarrow as pa
        if partition is None:  # Spark's stand-in where there is no partition at all
            return
        system, inner = file_system(partition.path)
        held, chars = ([], []), 0
        archive = partition.path.rsplit("/", 1)[-1]

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([archive] * len(held[0]), pa.string()), *[pa.array(h, pa.string()) for h in held]],
                names=["archive", "origin_file", "record"])
        with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
            for name in partition.names:
                with z.open(name) as stream:
                    for record in records(stream, f"{partition.path}/{name}"):
                        held[0].append(name.rsplit("/", 1)[-1])
                        held[1].append(record)
                        chars += len(record)
                        if len(held[0]) >= BATCH_RECORDS or chars >= BATCH_CHARS:
                            yield batch()
                            held, chars = ([], []), 0
        if held[0]:
            yield batch()


class JsonArchives(DataSource):
    """spark.read.format("json_archives").load(path)"""

    @classmethod
    def name(cls):
        return "json_archives"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_archives(spark: SparkSession, path: str, skip: str = "statistics.json", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(archive, origin_file, record) of every record below a path."""
    spark.dataSource.register(JsonArchives)
    return (spark.read.format("json_archives").option("skip", skip).option("partitionBytes", partition_bytes)
            .load(path))


def write_archives(df: DataFrame, path: str, member: str, record: str) -> int:
    """Writes a folder of archives, one per task: the JSON texts of ``record``
    as arrays, one member per value of ``member``, and a ``statistics.json`` with
    the number of records of each.  A task writes beside its archive and moves it
    into place when it is whole, so a task that is run again replaces its own
    file.  The rows should be grouped by ``member`` within tasks; they are sorted
    by it.  Returns the number of records."""
    system, inner = file_system(path)
    system.create_dir(inner, recursive=True)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task = TaskContext.get()
        fs, folder = file_system(path)
        target = f"{folder}/part-{task.partitionId():05d}.zip"
        beside = f"{target}.{task.taskAttemptId()}.tmp"
        counts, now, out = {}, None, None
        with fs.open_output_stream(beside) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if name != now:
                        if out is not None:
                            out.write(b"]")
                            out.close()
                        now, out = name, z.open(name, "w", force_zip64=True)
                    out.write((b"[" if name not in counts else b",\n") + text.encode())
                    counts[name] = counts.get(name, 0) + 1
            if out is not None:
                out.write(b"]")
                out.close()
            z.writestr("statistics.json", json.dumps(counts))
        if counts:
            fs.move(beside, target)
        else:
            fs.delete_file(beside)
        yield pa.RecordBatch.from_arrays([pa.array([sum(counts.values())])], names=["n"])
    rows = df.select(F.col(member).alias("member"), F.col(record).alias("record")).sortWithinPartitions("member")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).head()[0] or 0


from convgraph.session import pickle_by_value  # noqa: E402

pickle_by_value(__name__)
