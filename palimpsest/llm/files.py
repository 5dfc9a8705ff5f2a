"""Own binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark import TaskContext


@contextlib.contextmanager
def output(folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A new file that appears under its name only when whole. A task that runs again writes the same bytes anew, so the
    last one to finish wins."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(attempt) as out:
        yield out
    store.move(attempt, f"{path}/{name}")


@contextlib.contextmanager
def opened(folder: str, name: str) -> Iterator[pa.NativeFile]:
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        yield f


def sized_slices(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose column `name` has about limit bytes; at least one row each."""
    total, at = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(name)).to_pylist()):
        if total + (n or 0) > limit and i > at:
            yield batch.slice(at, i - at)
            total, at = 0, i
        total += n or 0
    if at < len(batch):
        yield batch.slice(at)
