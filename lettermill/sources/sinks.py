"""One object for each document, all of them or none half: staged by tasks, moved when every task is done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.sources.tables import written

STAGED = "name string, staged string, length long"
DONE = "_SUCCESS"


def file_system(root: str):
    """The file system of a folder (a path, or a URI that Arrow knows: file, hdfs, s3, gs) and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def write_objects(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows (name, content: string or binary) as objects below a folder and returns name and length of each.

    Each attempt of a task stages its objects in a folder of its own, and says what it staged; Spark keeps what successful attempts say.
    Only then these are moved to their names, by tasks again (a move that has been done is passed over), and at last the
    staged rest goes and _SUCCESS is written. So a failed or repeated attempt leaves no object and no half of one under a name.
    Null contents are empty. Names that repeat, or lead out of the folder, are refused before anything is moved.
    """
    home = f"_staged/{uuid.uuid4().hex}"

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (fs, base), task = file_system(root), TaskContext.get()
        folder = f"{home}/{task.partitionId()}-{task.taskAttemptId()}"
        fs.create_dir(f"{base}/{folder}", recursive=True)
        n = 0
        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with fs.open_output_stream(f"{base}/{folder}/{n}") as f:
                    f.write(content or b"")
                out.append((name, f"{folder}/{n}", len(content or b"")))
                n += 1
            yield pd.DataFrame(out, columns=["name", "staged", "length"])

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        fs, base = file_system(root)
        for batch in batches:
            for name, staged in zip(batch["name"], batch["staged"], strict=True):
                begun, ended = fs.get_file_info([f"{base}/{staged}", f"{base}/{name}"])
                if begun.type != FileType.NotFound:
                    fs.create_dir(ended.path.rsplit("/", 1)[0], recursive=True)
                    fs.move(begun.path, ended.path)
                elif ended.type == FileType.NotFound:
                    raise FileNotFoundError(begun.path)
            yield batch[["name", "length"]]

    contents = rows.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    staged = written(contents.mapInPandas(stage, STAGED))
    fs, base = file_system(root)
    try:
        odd = staged.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("name").isNull() | F.col("name").rlike(r"^/|^_|(^|/)\.\.?(/|$)|^$|/$")).limit(5).collect()
        if odd:
            raise ValueError(f"names of objects have to be single ones below the folder: {[r['name'] for r in odd]}")
        moved = written(staged.mapInPandas(move, "name string, length long"))
    finally:
        fs.delete_dir(f"{base}/{home}") if staged.limit(1).count() else None
    with fs.open_output_stream(f"{base}/{DONE}") as f:
        f.write(b"")
    return moved


def write_markdown(docs: DataFrame, path: str) -> DataFrame:
    """A markdown file for each document (stem, text), named by its stem."""
    return write_objects(docs.select(F.concat("stem", F.lit(".md")).alias("name"), F.col("text").alias("content")), path)


def write_uploads(requests: DataFrame, root: str) -> DataFrame:
    """request_id, file_ord, path and length of uploaded contents (request_id, contents: array of binary), written as root/request/ordinal.pdf."""
    each = requests.select("request_id", F.posexplode("contents").alias("file_ord", "content")).withColumn("name", F.format_string("%s/%d.pdf", "request_id", "file_ord"))
    done = write_objects(each, root)
    return each.select("request_id", "file_ord", "name").join(done, "name").select("request_id", "file_ord", F.concat(F.lit(f"{root}/"), "name").alias("path"), "length")
