"""Override lists and entity tables in markdown as formats of ``spark.read``, with the lines that can't be read and why."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.operators.graph import NER_LABELS

#: An entry of an override list, and a row of an entity table (fixed patterns).
ENTRY = re.compile(r'^\s*-\s+"(?P<term>[^"]+)"\s*:\s*(?P<label>[A-Z_]+)(?P<flags>(?:\s*,\s*[A-Za-z_]+\s*:\s*[A-Za-z0-9]+)*)\s*$')
ROW = re.compile(r"^\|\s*(?P<name>[^|]+?)\s*\|\s*`(?P<link>\[\[[^\]]+\]\])`\s*\|\s*`(?P<page>[^`]+)`\s*\|")
#: Words of a heading and the type of what stands below it (fixed values).
HEADINGS = {
    "clients": "organisation", "key organisations": "organisation", "active projects": "project", "frameworks": "framework",
    "key people": "person", "agent platform": "component",
}


def override_rows(lines: Iterator[str]) -> Iterator[tuple]:
    """(line, term, label, fault) of each list item; a term of any case is there as written, upper, lower and with capitals first.

    Lines that are no list items are prose. An item that can't be read, or whose label is unknown, has a fault instead of a term.
    """
    for number, line in enumerate(lines, 1):
        if not line.strip().startswith("-"):
            continue
        entry = ENTRY.match(line)
        if not entry or not entry["term"].strip():
            yield number, None, None, "not an entry"
        elif entry["label"] not in NER_LABELS:
            yield number, None, None, f"unknown label {entry['label']}"
        else:
            term = entry["term"].strip()
            flags = {k.lower(): v.lower() for k, v in re.findall(r"([A-Za-z_]+)\s*:\s*([A-Za-z0-9]+)", entry["flags"])}
            forms = {term, term.upper(), term.lower(), term.title()} if flags.get("case_insensitive") in ("true", "1", "yes") else {term}
            for form in sorted(forms):
                yield number, form, entry["label"], None


def entity_rows(lines: Iterator[str]) -> Iterator[tuple]:
    """(line, name, aliases, link, page, type, fault) of each row of a table; the type is that of the last second-level heading that tells one.

    Of rows with one name the first counts. Heads and rules of tables are none; any other row that can't be read has a fault.
    """
    kind, seen = "unknown", set()
    for number, line in enumerate(lines, 1):
        if line.startswith("## "):
            kind = next((t for words, t in HEADINGS.items() if words in line.lower()), kind)
        if not line.startswith("|") or re.fullmatch(r"[|\s:-]+", line.strip()):
            continue
        row = ROW.match(line.replace("\\|", "\x00"))
        first = line.strip("| ").split("|")[0].strip().lower()
        if not row:
            if first not in ("entity", "name"):
                yield number, None, None, None, None, None, "not a row of an entity"
            continue
        name, link = row["name"].replace("\x00", "|").strip(), row["link"].replace("\x00", "|")
        page = re.sub(r"\s*\([^)]*\)\s*$", "", row["page"].strip())
        if name.lower() in ("entity", "name"):
            continue
        if not page:
            yield number, None, None, None, None, None, "no page"
        elif name not in seen:
            seen.add(name)
            parts = dict.fromkeys(x for x in link[2:-2].split("|", 1) if x and x != name)
            yield number, name, list(parts), link, page, kind, None


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Lines(DataSourceReader):
    """A partition a file. Files are those of the folder, or the file, that ``path`` names in a store that Arrow opens (local, HDFS, S3, GCS)."""

    def __init__(self, options: dict, rows):
        self.path, self.suffix, self.rows = options.get("path"), options.get("suffix", ".md"), rows
        if not self.path:
            raise ValueError("this format needs a path")

    def partitions(self) -> Sequence[InputPartition]:
        uri = self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}"
        store, path = fs.FileSystem.from_uri(uri)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            return []
        files = store.get_file_info(fs.FileSelector(path, recursive=True)) if found.type == fs.FileType.Directory else [found]
        base = uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"
        return [_File(base + x.path) for x in sorted(files, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.endswith(self.suffix)]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # there are no files
            return
        store, path = fs.FileSystem.from_uri(partition.path)
        with store.open_input_stream(path) as f:
            text = f.read().decode("utf-8", "replace")
        for row in self.rows(iter(text.splitlines())):
            yield (partition.path, *row)


class OverrideLists(DataSource):
    """``spark.read.format("override_list").load(path)``: list items of markdown files."""

    @classmethod
    def name(cls) -> str:
        return "override_list"

    def schema(self) -> str:
        return "path string, line int, term string, label string, fault string"

    def reader(self, schema) -> DataSourceReader:
        return _Lines(self.options, override_rows)


class EntityTables(DataSource):
    """``spark.read.format("entity_table").load(path)``: rows of entity tables in markdown files."""

    @classmethod
    def name(cls) -> str:
        return "entity_table"

    def schema(self) -> str:
        return "path string, line int, name string, aliases array<string>, link string, page string, type string, fault string"

    def reader(self, schema) -> DataSourceReader:
        return _Lines(self.options, entity_rows)


def register(spark: SparkSession) -> None:
    """Make the formats of this module known to a session."""
    for source in (OverrideLists, EntityTables):
        spark.dataSource.register(source)


def faults(rows: DataFrame) -> DataFrame:
    """(path, fault, n, first_line): how many lines of each file couldn't be read, and why."""
    return rows.where("fault IS NOT NULL").groupBy("path", "fault").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))
