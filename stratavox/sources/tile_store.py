"""Files of rows as a data source that commits as a whole: `df.write.format("tile_files").save(uri)`.

Rows have `path` and `content`. Tasks write into a staging folder beside the files and list there
what they wrote; the job's commit moves it all to its place, an abort removes the folder. So a job
that fails, at whatever task, leaves no file and changes none. `append` replaces files of the same
name, `overwrite` also removes all others. Any store that pyarrow reaches will do.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ship

FORMAT = "tile_files"
STAGING = "_staging-"


@dataclass
class Wrote(WriterCommitMessage):
    """The list of one task: a file of lines (staged, path); its length is all that the driver hears of."""

    listing: str
    files: int


class TileWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.job = uri, overwrite, f"{STAGING}{uuid.uuid4().hex}"
        # Made once, here, and not by the tasks: one that still runs after an abort can't bring it back.
        store, _, staging = self._open()
        store.create_dir(staging, recursive=True)

    def _open(self):
        store, root = fs.FileSystem.from_uri(self.uri)
        return store, root.rstrip("/"), f"{root.rstrip('/')}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        store, _, staging = self._open()
        task, n = uuid.uuid4().hex, 0
        with store.open_output_stream(f"{staging}/{task}.list") as listing:
            for batch in iterator:
                for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                    if not path or path.startswith(("/", "_")) or ".." in path.split("/") or content.as_buffer() is None:
                        raise ValueError(f"no file can be written for {path!r}")
                    staged = f"{task}-{n}"
                    with store.open_output_stream(f"{staging}/{staged}") as out:
                        out.write(content.as_buffer())
                    listing.write((json.dumps([staged, path]) + "\n").encode())
                    n += 1
        return Wrote(f"{task}.list", n)

    def commit(self, messages: list[Wrote | None]) -> None:
        store, root, staging = self._open()
        store.create_dir(f"{staging}/old", recursive=True)
        moved: list[tuple[str, str]] = []  # of older files that make place

        def aside(at: str) -> None:
            kept = f"{staging}/old/{uuid.uuid4().hex}"
            store.move(at, kept)
            moved.append((kept, at))

        def place(line: bytes) -> str:
            staged, path = json.loads(line)
            at = f"{root}/{path}"
            store.create_dir(at.rsplit("/", 1)[0], recursive=True)
            if store.get_file_info(at).type != fs.FileType.NotFound:
                aside(at)
            store.move(f"{staging}/{staged}", at)
            return at

        lists = [f"{staging}/{m.listing}" for m in messages if m and m.files]
        try:
            if self.overwrite:
                for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                    if not info.base_name.startswith(STAGING):
                        aside(info.path)
            with ThreadPoolExecutor(16) as pool:
                for at in lists:
                    with store.open_input_stream(at) as listing:
                        for _ in pool.map(place, listing.read().splitlines()):
                            pass
        except Exception:
            self._undo(store, root, lists, moved)
            raise
        store.delete_dir(staging)

    @staticmethod
    def _undo(store, root: str, lists: list[str], moved: list[tuple[str, str]]) -> None:
        for at in lists:
            with store.open_input_stream(at) as listing:
                for line in listing.read().splitlines():
                    staged, path = json.loads(line)
                    if store.get_file_info(f"{at.rsplit('/', 1)[0]}/{staged}").type == fs.FileType.NotFound and store.get_file_info(f"{root}/{path}").type == fs.FileType.File:
                        store.delete_file(f"{root}/{path}")
        for kept, at in reversed(moved):
            store.move(kept, at)

    def abort(self, messages: list[Wrote | None]) -> None:
        store, _, staging = self._open()
        for wait in (0.0, 0.2, 1.0, 3.0):  # a task that is being stopped may put a file there meanwhile
            time.sleep(wait)
            try:
                if store.get_file_info(staging).type == fs.FileType.NotFound:
                    return
                store.delete_dir(staging)
            except OSError:
                continue


class TileFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> TileWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("rows need path and content")
        return TileWriter(self.options["path"], overwrite)


def save(rows: DataFrame, uri: str, mode: str = "append") -> None:
    """Writes `content` of each row to `path` below the folder `uri`, all or nothing. Of rows with one path, any may win."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(TileFiles)
    rows.select("path", "content").write.format(FORMAT).mode(mode).save(uri)
