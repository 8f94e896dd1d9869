"""Files that tasks write into, and read from, a shared folder of any file system pyarrow knows.

Names are unique to an attempt. What counts is the table of names that Spark commits afterwards, so a
task that is run twice or lost half-way leaves at most a file that nobody reads.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def new_name(folder: str, suffix: str) -> str:
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return f"{folder}/part-{part:05d}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    system, path = _located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_random(uri: str):
    system, path = _located(uri)
    return system.open_input_file(path)


def one_task_per_file(names: DataFrame, tasks: int = 4096) -> DataFrame:
    """Deal a table of file names to as many tasks as there are names, up to ``tasks``."""
    return names.repartition(max(1, min(tasks, names.count())))
