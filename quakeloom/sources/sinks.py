"""Writers that never overwrite: content-addressed archives, and claims of a run that is issued once."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.issuance import archive_keys, run_id
from ..plans.checkpointing import materialize


def create_once(where: fs.FileSystem, path: str, content: bytes) -> bool:
    """Writes a file that appears whole or not at all, unless there is one; whether it is this one's.

    The content goes to a name of its own first. On a local file system the final name is a hard link,
    which fails if the name is taken, so that of several writers at once one wins; others check and move,
    which is safe where equal names have equal content."""
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    if where.get_file_info(path).type != fs.FileType.NotFound:
        return False
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(temporary) as out:
        out.write(content)
    if isinstance(where, fs.LocalFileSystem):
        try:
            os.link(temporary, path)
            return True
        except FileExistsError:
            return False
        finally:
            where.delete_file(temporary)
    if where.get_file_info(path).type != fs.FileType.NotFound:
        where.delete_file(temporary)
        return False
    where.move(temporary, path)
    return True


def write_archive(artifacts: DataFrame, url: str) -> DataFrame:
    """Stores ``artifacts`` (source, content, media_type) under ``url`` as source/aa/bb/sha.ext, each content of
    a source once; returns (source, sha256, uri, byte_length, written) for the distinct ones.

    ``written`` is false for what was there. Tasks write what they hold; one that is run again finds its
    files and changes nothing. Rows without a source or content are left out."""
    keyed = archive_keys(artifacts.where("source is not null and content is not null").select("source", "content", "media_type"))
    rows = keyed.dropDuplicates(["source", "sha256"]).select("source", "sha256", "path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(url)
        for b in batches:
            paths, contents = b.column(2).to_pylist(), b.column(3)
            made = [create_once(where, f"{root}/{path}", x.as_py()) for path, x in zip(paths, contents, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f"{url.rstrip('/')}/{p}" for p in paths], pa.string()), pa.array([len(x.as_py()) for x in contents], pa.int64()), pa.array(made, pa.bool_())], ["source", "sha256", "uri", "byte_length", "written"])

    # written down: files are made once, whatever the caller does with the rows
    return materialize(rows.mapInArrow(run, "source string, sha256 string, uri string, byte_length long, written boolean"), "archived")


def read_archive(spark, url: str) -> DataFrame:
    """(source, sha256, content) of an archive; content that no longer matches its name is an error.

    Spark's reader leaves files without content out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url)
    parts = F.split("path", "/")
    name = F.regexp_extract(F.element_at(parts, -1), r"^([0-9a-f]{64})\.", 1)
    own = F.sha2("content", 256)
    checked = F.when(own == name, name).otherwise(F.raise_error(F.concat(F.lit("content differs from its name: "), F.col("path"))))
    return files.where("path not like '%.tmp'").select(F.element_at(parts, -4).alias("source"), checked.alias("sha256"), "content")


def issue_once(requests: DataFrame, table: str, claims: str, fields: list[str], issuer: str | None = None) -> DataFrame:
    """Appends the requests whose run (``fields``) nobody has issued yet to ``table``, partitioned by issuer;
    returns them.

    A run is claimed by creating a file named after it in ``claims``, which one of several issuers at once
    can do. The file names its issuer, so that a task that is run again, or an issuer that starts again
    under its name after it died, still holds its claim; rows that it already wrote are not written twice."""
    spark, token = requests.sparkSession, issuer or uuid.uuid4().hex
    rows = requests.withColumn("run_id", run_id(fields)).dropDuplicates(["run_id"])
    names, kinds = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(claims)
        for b in batches:
            won = []
            for run in b.column(names.index("run_id")).to_pylist():
                path = f"{root}/{run}"
                if create_once(where, path, token.encode()):
                    won.append(True)
                else:
                    with where.open_input_stream(path) as held:
                        won.append(held.read() == token.encode())
            yield b.filter(pa.array(won, pa.bool_()))

    won = materialize(rows.mapInArrow(claim, kinds), "claimed")
    try:
        held = spark.read.schema(won.schema).parquet(table)
        won = materialize(won.join(held.select("run_id"), "run_id", "left_anti").select(*names), "issued")
    except Exception as e:  # the first run finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    # a folder for each issuer: writers at once don't share Spark's temporary folder
    won.write.mode("append").parquet(f"{table}/issuer={token}")
    return won
