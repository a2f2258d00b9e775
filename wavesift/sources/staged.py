"""Sinks of single files: tasks stage them, the driver moves them to their places or drops them all.

A task writes below a hidden folder of its own and reports the names. When all tasks are done, the
driver moves the files; if one fails for good, the staging folder goes and the tree is as it was. Only
the driver makes that folder, so a task that is still at work when it goes can't bring it back. A
task that runs again stages anew, and what its lost attempt left goes with the folder. Files of the
same name are replaced, others stay, so the mode is always append. A name that two rows or tasks give is an error.
"""

from __future__ import annotations

import io
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wavesift.sources.stores import opened

#: Files that the driver moves at a time, and times that it takes away a folder in which tasks still write.
MOVES, DROPS = 32, 20


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


def _inside(name: str) -> str:
    """A name that stays below the root."""
    parts = name.split("/")
    if name.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"no name of a file below the root: {name}")
    return name


class StagedWriter(DataSourceArrowWriter):
    """Writes what ``files`` makes of the rows of a task."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        if overwrite:
            raise ValueError("files of the same name are replaced and others stay: use mode append")
        self.root = options["path"]
        self.staging = f".staged-{uuid.uuid4().hex}"
        store, root = opened(self.root)
        store.create_dir(f"{root}/{self.staging}", recursive=True)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = opened(self.root)
        folder, names = f"{self.staging}/{uuid.uuid4().hex}", []
        for name, content in self.files(iterator):
            path = f"{root}/{folder}"
            for part in _inside(name).split("/"):
                store.create_dir(path, recursive=False)
                path = f"{path}/{part}"
            with store.open_output_stream(path) as out:
                out.write(content)
            names.append(name)
        return Staged(folder, names)

    def _drop(self) -> None:
        store, root = opened(self.root)
        for left in reversed(range(DROPS)):
            if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.Directory:
                return
            try:
                store.delete_dir(f"{root}/{self.staging}")
            except OSError:  # a task wrote another file meanwhile
                if not left:
                    raise
                time.sleep(0.05)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = opened(self.root)
        placed = [(m.folder, name) for m in messages if m is not None for name in m.names]
        if len({name for _, name in placed}) < len(placed):
            self._drop()
            raise ValueError("a file is written twice; bring its rows together and give each its own name")

        def move(item: tuple[str, str]) -> None:
            folder, name = item
            store.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            store.move(f"{root}/{folder}/{name}", f"{root}/{name}")

        store.create_dir(root, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(move, placed))
        self._drop()

    def abort(self, messages: list[Staged | None]) -> None:
        self._drop()


class _Contents(StagedWriter):
    def files(self, batches):
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content")):
                if content.is_valid:
                    yield name.as_py(), content.as_buffer()


class _Archives(StagedWriter):
    """One compressed archive for each run of rows of a file, in order of frames."""

    def _archive(self, parts: list[pa.RecordBatch]) -> bytes:
        rows = pa.Table.from_batches(parts).sort_by("frame").combine_chunks()
        bins = rows.column("bins").combine_chunks()
        feature = bins.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(bins), -1).T
        out = io.BytesIO()
        np.savez_compressed(out, feature=feature[None], sr=rows.column("sr")[0].as_py(), source_path=rows.column("source_path")[0].as_py() or "")
        return out.getvalue()

    def files(self, batches):
        held, name = [], None
        for batch in batches:
            files = batch.column("file").to_pylist()
            at = 0
            while at < len(files):
                end = next((i for i in range(at, len(files)) if files[i] != files[at]), len(files))
                if held and files[at] != name:
                    yield name, self._archive(held)
                    held = []
                name = files[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield name, self._archive(held)


class Files(DataSource):
    """Rows (name, content) as files below a folder; null contents are left out."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return _Contents(self.options, overwrite)


class Archives(DataSource):
    """Rows (file, frame, bins, sr, source_path), a file's rows together, as ``.npz`` archives at the file's place below a folder."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "file string, frame long, bins array<double>, sr int, source_path string"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return _Archives(self.options, overwrite)


def save_files(rows: DataFrame, folder: str) -> None:
    """Write (name, content) below a folder."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(Files)
    rows.select("name", "content").write.format("files").mode("append").save(folder)


def save_archives(frames: DataFrame, folder: str) -> None:
    """Write spectrograms (file, frame, bins, sr, source_path), one archive for each file; a task holds one file at a time."""
    spark: SparkSession = frames.sparkSession
    spark.dataSource.register(Archives)
    rows = frames.select("file", "frame", "bins", "sr", "source_path").repartition("file").sortWithinPartitions("file", "frame")
    rows.write.format("archives").mode("append").save(folder)
