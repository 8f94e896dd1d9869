"""Per-file work on many files at once: first lines, content hash, managed copy.

Files are listed by Spark's binary source without reading their content; each task then opens its
own files through Arrow's file systems. Only the few lines or the chunk at hand is held in memory.
"""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import posixpath
import re
import statistics
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.errors import ReadError
from tieout.functions.cells import PLAIN_NUMBER

# How far a layout or delimiter is looked for, and the delimiters in order.
LAYOUT_ROWS = 25
SNIFF_LINES = 40
DELIMITERS = ["\t", ",", ";", "|"]
TAB_SUFFIXES = [".tsv", ".tab"]
COMMA_SUFFIXES = [".csv", ".txt"]
PARQUET_SUFFIXES = [".parquet", ".pq"]
CHUNK = 1 << 20

# What counts as separator or decoration when asking whether a cell is a number.
CELL_CLUTTER = r"[,\s_$£€%()]"


def list_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """path, length and modificationTime of files; part-written and lock files are left out."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(path).select("path", "length", "modificationTime").where(
        ~name.startswith("~$") & ~name.endswith(".partial"))


def _open(path: str):
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(path)


def separator_for(path: str) -> str:
    return "\t" if posixpath.splitext(path.lower())[1] in TAB_SUFFIXES else ","


def head_lines(path: str, separator: str, rows: int = LAYOUT_ROWS) -> tuple[list[list[str]], list[int]]:
    """The first records of one file, and how many lines are read at the end of each."""
    system, inner = _open(path)
    with system.open_input_stream(inner) as raw:
        text = io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline="")
        reader, found, ends = csv.reader(text, delimiter=separator), [], []
        for row in itertools.islice(reader, rows):
            found.append(row)
            ends.append(reader.line_num)
        return found, ends


def head_rows(path: str, separator: str, rows: int = LAYOUT_ROWS) -> list[list[str]]:
    """The first records of one file."""
    return head_lines(path, separator, rows)[0]


def _is_number(cell: str) -> bool:
    return bool(re.match(PLAIN_NUMBER, re.sub(CELL_CLUTTER, "", cell)))


def layout_of(rows: list[list[str]]) -> int:
    """Index of the header row: the first row as wide as any, all labels distinct, none a number.

    Rows with more fields than most rows have are prose with separators in it and are passed over.
    """
    usual = min(statistics.multimode(map(len, rows)), default=0)
    labels = [[cell for cell in map(str.strip, row) if cell] if len(row) <= usual else [] for row in rows]
    width = max(map(len, labels), default=0)

    def heads(cells: list[str]) -> bool:
        return 0 < width == len(cells) == len(set(map(str.lower, cells))) and not any(map(_is_number, cells))

    return next((place for place, cells in enumerate(labels) if heads(cells)), 0)


def delimiter_of(lines: list[str]) -> str | None:
    """The delimiter whose count per line, outside quotes, is the steadiest and then the highest."""
    bare = [re.sub('"[^"]*"?', "", line) for line in lines if line.strip()][:SNIFF_LINES]

    def steadiness(mark: str) -> tuple[int, int]:
        """Lines with the usual count of the mark, and that count; nothing where most lines have none."""
        counts = [line.count(mark) for line in bare]
        usual = statistics.mode(counts)
        return (counts.count(usual), usual) if usual else (0, 0)

    best = max(DELIMITERS, key=steadiness) if bare else None
    return best if best and any(steadiness(best)) else None


def detect_layouts(files: DataFrame) -> DataFrame:
    """header_row and preamble_rows of every listed file, in one job."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = [layout_of(head_rows(p, separator_for(p))) for p in batch["path"]]
            yield pd.DataFrame({"path": batch["path"], "header_row": at, "preamble_rows": at})
    return files.select("path").mapInPandas(run, "path string, header_row int, preamble_rows int")


def file_headers(files: DataFrame, separator: str | None = None, header_row: int | None = None) -> DataFrame:
    """separator, header_row and header labels of every listed file, and the number of lines up to the header's end;
    labels are null where there is no such row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                mark = separator or separator_for(path)
                rows, ends = head_lines(path, mark, LAYOUT_ROWS if header_row is None else header_row + 1)
                at = layout_of(rows) if header_row is None else header_row
                known = at < len(rows)
                found.append((path, mark, at, rows[at] if known else None, ends[at] if known else 0))
            yield pd.DataFrame(found, columns=["path", "separator", "header_row", "labels", "header_lines"])

    return files.select("path").mapInPandas(
        run, "path string, separator string, header_row int, labels array<string>, header_lines int")


def header_labels(files: DataFrame) -> DataFrame:
    """The header labels of every listed file, one row per label."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for p in batch["path"]:
                rows = head_rows(p, separator_for(p))
                found += [(p, i, label) for i, label in enumerate(rows[layout_of(rows)] if rows else [])]
            yield pd.DataFrame(found, columns=["path", "position", "label"])
    return files.select("path").mapInPandas(run, "path string, position int, label string")


def detect_delimiters(files: DataFrame) -> DataFrame:
    """The delimiter of every listed file; null where none of the candidates occurs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for p in batch["path"]:
                system, inner = _open(p)
                with system.open_input_stream(inner) as raw:
                    text = io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace")
                    lines = itertools.islice((line.rstrip("\n") for line in text if line.strip()), SNIFF_LINES)
                    found.append(delimiter_of(list(lines)))
            yield pd.DataFrame({"path": batch["path"], "delimiter": found})
    return files.select("path").mapInPandas(run, "path string, delimiter string")


def _digest(path: str) -> str:
    system, inner = _open(path)
    digest = hashlib.sha256()
    with system.open_input_stream(inner) as raw:
        while chunk := raw.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def content_hashes(files: DataFrame) -> DataFrame:
    """SHA-256 of every listed file, read in chunks, so size does not matter."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sha256=[_digest(p) for p in batch["path"]])
    return files.select("path", "length", "modificationTime").mapInPandas(
        run, "path string, length bigint, modificationTime timestamp, sha256 string")


def copy_files(files: DataFrame) -> DataFrame:
    """Copy each ``path`` to its ``managed_path`` unless it is there; the rows pass through.

    A copy is written under another name and then moved, so a repeated or lost task leaves either
    the whole file or none.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for source, target in zip(batch["path"], batch["managed_path"]):
                (from_fs, inner), (to_fs, out) = _open(source), _open(target)
                if to_fs.get_file_info(out).type == fs.FileType.File:
                    continue
                to_fs.create_dir(posixpath.dirname(out), recursive=True)
                part = f"{out}.{uuid.uuid4().hex}.partial"
                with from_fs.open_input_stream(inner) as raw, to_fs.open_output_stream(part) as sink:
                    while chunk := raw.read(CHUNK):
                        sink.write(chunk)
                to_fs.move(part, out)
            yield batch
    return files.mapInPandas(run, files.schema)


def suffix_of(path: str) -> str:
    suffix = posixpath.splitext(path.lower())[1]
    if suffix not in COMMA_SUFFIXES + TAB_SUFFIXES + PARQUET_SUFFIXES:
        raise ReadError(f"cannot read {suffix or 'a file without a suffix'}: {path}")
    return suffix
