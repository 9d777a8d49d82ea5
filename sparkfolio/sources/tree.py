"""The extraction tree as a Spark data source: ``<root>/<slug>/document.json`` and ``<root>/<slug>/pages/page_*.json``.

A row is a file: slug, file_name, content. JSON is built and parsed by Spark's own functions (``tree_files``, ``tree_pages``, ``tree_documents``);
the source lists, reads and writes files. Names are listed on the driver, as Spark's file sources do; contents are read and written by tasks.
Of names, the driver holds those of a document at a time, and packed ones; tasks leave sorted lists of what they wrote in the staging folder, which the commit merges and goes through.

A write goes to a staging folder first. ``append`` merges a file into the one that is there, key by key, and leaves files that say the same already untouched;
``overwrite`` replaces the documents it writes as wholes and leaves other documents alone. The commit moves pages, then each ``document.json``, then adds a list of the
changed files to ``<root>/_commits``; a write that fails before it leaves the tree as it was. Two writers must not commit to one tree at the same time.
A stream follows the lists, so it sees what was written through this source.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..functions.batches import SLICE, give_back, slices, small_batches
from . import schemas

NAME, SCHEMA = "extraction_tree", "slug string, file_name string, content string"
DOCUMENT, PAGE = "document.json", re.compile(r"page_[^/]*\.json")
COMMITS, STAGING = "_commits", "_staging"
#: Files that a task reads, bytes of a batch it gives, and moves that a commit makes at a time.
FILES, BATCH_BYTES, MOVES = 1000, SLICE, 16
#: Names that are held at a time, lists that are merged at a time, and bytes that are read of each.
NAMES, LISTS, LIST_BYTES = 10_000, 64, 1 << 16

File = tuple[str, str]  # slug, file name
Row = tuple[str, str, str]  # slug, file name, the folder it is staged in or "" where it said the same already


class Tree:
    """The files under a root; the root is a path or a URI."""

    def __init__(self, root: str):
        self.system, self.base = fs.FileSystem.from_uri(root) if re.match(r"[a-z0-9]+:/", root) else (fs.LocalFileSystem(), os.path.abspath(root))
        self.base = self.base.rstrip("/")

    def path(self, file: File, base: str | None = None) -> str:
        slug, name = file
        return f"{base or self.base}/{slug}/{name}" if name == DOCUMENT else f"{base or self.base}/{slug}/pages/{name}"

    def _names(self, folder: str, kind: fs.FileType) -> list[str]:
        if isinstance(self.system, fs.LocalFileSystem):  # its names come one by one
            try:
                with os.scandir(folder) as found:
                    return sorted(f.name for f in found if not f.name.startswith(("_", ".")) and (f.is_dir() if kind == fs.FileType.Directory else f.is_file()))
            except FileNotFoundError:
                return []
        found = self.system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == kind and not f.base_name.startswith(("_", ".")))

    def slugs(self) -> list[str]:
        return self._names(self.base, fs.FileType.Directory)

    def pages(self, slug: str) -> list[File]:
        return [(slug, n) for n in self._names(f"{self.base}/{slug}/pages", fs.FileType.File) if PAGE.fullmatch(n)]

    def files(self, slug: str) -> list[File]:
        return [*((slug, n) for n in self._names(f"{self.base}/{slug}", fs.FileType.File) if n == DOCUMENT), *self.pages(slug)]

    def all_files(self, slugs: list[str]) -> Iterator[File]:
        """Files of documents in turn; small documents are listed side by side."""
        rest, side_by_side = iter(slugs), 1
        with ThreadPoolExecutor(MOVES) as pool:
            while some := list(islice(rest, side_by_side)):
                found = list(pool.map(self.files, some))
                side_by_side = min(MOVES, 2 * side_by_side) if sum(map(len, found)) < NAMES else 1
                for of_slug in found:
                    yield from of_slug

    def read(self, file: File) -> bytes | None:
        try:
            with self.system.open_input_stream(self.path(file)) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def write(self, path: str, content: bytes) -> None:
        with self.system.open_output_stream(path) as f:
            f.write(content)

    def write_lines(self, path: str, rows: Iterable) -> int:
        """Writes rows as lines of JSON into a folder that is there; returns how many there are."""
        count = 0
        with self.system.open_output_stream(path) as f:
            for some in batched(rows, NAMES):
                f.write("".join(json.dumps(row) + "\n" for row in some).encode())
                count += len(some)
        return count

    def lines(self, path: str) -> Iterator:
        """What ``write_lines`` wrote. The file is open only while a piece of it is read, so any number can be read in turn."""
        at, rest = 0, b""
        while True:
            with self.system.open_input_file(path) as f:
                f.seek(at)
                piece = f.read(LIST_BYTES)
            at += len(piece)
            *whole, rest = (rest + piece).split(b"\n")
            yield from map(json.loads, whole if piece or not rest else [rest])
            if not piece:
                return

    def in_order(self, lists: list[str], drafts: str) -> Iterator[list[str]]:
        """Rows of sorted lists in their order; more than LISTS of them are merged in rounds, into files whose names begin with ``drafts``."""
        number = 0
        while len(lists) > LISTS:
            fewer = []
            for some in batched(lists, LISTS):
                fewer.append(f"{drafts}-{number}.json")
                self.write_lines(fewer[-1], heapq.merge(*map(self.lines, some)))
                number += 1
            lists = fewer
        return heapq.merge(*map(self.lines, lists))

    def commits(self) -> list[int]:
        found = self.system.get_file_info(fs.FileSelector(f"{self.base}/{COMMITS}", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if re.fullmatch(r"\d+\.json", f.base_name))

    def changed(self, after: int, until: int) -> Iterator[File]:
        """Files that a range of commits changed, each once and in order, as they stand in the list of each commit."""
        lists = [self.lines(f"{self.base}/{COMMITS}/{n:012d}.json") for n in self.commits() if after < n <= until]
        return (file for file, _ in groupby(heapq.merge(*(map(itemgetter("slug", "file_name"), rows) for rows in lists))))


@dataclass
class Files(InputPartition):
    """Files that a task reads; their names are packed, as the driver has those of all tasks."""

    packed: bytes

    @classmethod
    def of(cls, files: Iterable[File]) -> Files:
        return cls(zlib.compress(json.dumps(list(files)).encode()))

    @property
    def files(self) -> list[File]:
        return [(slug, name) for slug, name in json.loads(zlib.decompress(self.packed))]


def _blocks(files: Iterable[File], size: int) -> list[Files]:
    return [Files.of(some) for some in batched(files, size)]


def _contents(root: str, files: list[File]) -> Iterator[pa.RecordBatch]:
    tree, rows, size = Tree(root), [], 0
    for at, file in enumerate(files, 1):
        content = tree.read(file)
        if content is not None:  # else deleted since it was listed
            rows.append((*file, content.decode(errors="replace")))
            size += len(content)
        if rows and (size >= BATCH_BYTES or at == len(files)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["slug", "file_name", "content"])
            rows, size = [], 0


class TreeReader(DataSourceReader):
    """A document of many pages is many partitions. Equality on ``slug`` prunes documents before anything is listed."""

    def __init__(self, root: str, size: int):
        self.root, self.size, self.slugs = root, size, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("slug",):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.slugs = wanted if self.slugs is None else self.slugs & wanted
            else:
                yield f

    def partitions(self) -> list[Files]:
        tree = Tree(self.root)
        slugs = [s for s in tree.slugs() if self.slugs is None or s in self.slugs]
        return _blocks(tree.all_files(slugs), self.size) or [Files.of([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _contents(self.root, partition.files)


class TreeStreamReader(DataSourceStreamReader):
    """Files as commits change them, in their state at the time they are read; the offset is the number of a commit."""

    def __init__(self, root: str, size: int):
        self.root, self.size = root, size

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": max(Tree(self.root).commits(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _blocks(Tree(self.root).changed(start["commit"], end["commit"]), self.size) or [Files.of([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _contents(self.root, partition.files)

    def commit(self, end: dict) -> None:
        pass


def merged(old, new):
    """``new`` put into ``old``: objects key by key, lists of as many items item by item; a null says nothing."""
    if isinstance(old, dict) and isinstance(new, dict):
        return old | {k: merged(old.get(k), v) for k, v in new.items() if v is not None}
    if isinstance(old, list) and isinstance(new, list) and len(old) == len(new):
        return [merged(a, b) for a, b in zip(old, new)]
    return old if new is None else new


@dataclass
class Written(WriterCommitMessage):
    """The folder a task staged its files in, and in how many sorted lists there it has named them; the driver gets no names."""

    root: str
    folder: str
    lists: int = 0

    def add(self, rows: list[Row]) -> None:
        Tree(self.root).write_lines(self.path(self.lists), sorted(rows))
        self.lists += 1

    def path(self, number: int) -> str:
        return f"{self.folder}/_files-{number}.json"

    @property
    def changed(self) -> Iterator[File]:
        return ((slug, name) for n in range(self.lists) for slug, name, folder in Tree(self.root).lines(self.path(n)) if folder)


def _each(work: Callable, items: Iterable) -> None:
    with ThreadPoolExecutor(MOVES) as pool:
        for some in batched(items, NAMES):  # a pool takes in all it is given at once
            list(pool.map(lambda few: [work(x) for x in few], batched(some, 100)))


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, replace: bool):
        self.root, self.replace, self.staging = root, replace, f"{STAGING}-{uuid.uuid4().hex}"
        tree = Tree(root)
        tree.system.create_dir(f"{tree.base}/{self.staging}", recursive=True)  # by the driver alone, so that a task that outlives an abort fails and doesn't bring it back

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        tree, task = Tree(self.root), TaskContext.get()
        out = Written(self.root, f"{tree.base}/{self.staging}/{task.partitionId()}-{task.taskAttemptId()}")
        made, rows = set(), []
        tree.system.create_dir(out.folder, recursive=False)
        for batch in slices(iterator, "content"):  # else all texts of a batch are Python's at once
            for slug, name, content in zip(*(batch.column(c).to_pylist() for c in ("slug", "file_name", "content"))):
                if not slug or "/" in slug or slug[0] in "_." or content is None or not (name == DOCUMENT or PAGE.fullmatch(name or "")):
                    raise ValueError(f"no file of an extraction tree: slug {slug!r}, file {name!r}")
                file, there = (slug, name), tree.read((slug, name))
                if there is not None and not self.replace:
                    content = self._merge(there, content)
                if there is not None and there == content.encode():
                    rows.append((*file, ""))
                else:
                    if slug not in made:
                        for folder in (slug, f"{slug}/pages"):
                            tree.system.create_dir(f"{out.folder}/{folder}", recursive=False)
                        if len(made) == NAMES:
                            made.clear()
                        made.add(slug)
                    tree.write(tree.path(file, out.folder), content.encode())
                    rows.append((*file, out.folder))
                if len(rows) == NAMES:
                    out.add(rows)
                    rows = []
        if rows:
            out.add(rows)
        give_back()
        return out

    @staticmethod
    def _merge(there: bytes, content: str) -> str:
        try:
            old = json.loads(there)
        except ValueError:  # what is there is broken
            return content
        new = merged(old, json.loads(content))
        return there.decode() if new == old else json.dumps(new, ensure_ascii=False)

    def commit(self, messages: list[Written | None]) -> None:
        tree, staging, twice = Tree(self.root), f"{Tree(self.root).base}/{self.staging}", []
        files, draft = f"{staging}/files.json", f"{staging}/commit.json"

        def once(rows: Iterable[list[str]]) -> Iterator[list[str]]:
            for _, same in groupby(rows, itemgetter(0, 1)):
                yield (row := next(same))
                if next(same, None):
                    twice[:] = [twice[0] + 1, twice[1]] if twice else [1, f"{row[0]}/{row[1]}"]

        tree.write_lines(files, once(tree.in_order([m.path(n) for m in messages if m is not None for n in range(m.lists)], f"{staging}/merged")))
        if twice:
            self.abort(messages)
            raise ValueError(f"{twice[0]} files come more than once, {twice[1]} for one")

        def move(row: list[str]) -> None:
            tree.system.move(tree.path((row[0], row[1]), row[2]), tree.path((row[0], row[1])))

        def gone() -> Iterator[File]:
            for slug, rows in groupby(tree.lines(files), itemgetter(0)):
                written = {name for _, name, _ in rows}
                yield from (f for f in tree.pages(slug) if f[1] not in written)

        _each(lambda s: tree.system.create_dir(f"{tree.base}/{s}/pages", recursive=True), (s for s, _ in groupby(tree.lines(files), itemgetter(0))))
        _each(move, (row for row in tree.lines(files) if row[2] and row[1] != DOCUMENT))
        if self.replace:
            _each(lambda f: tree.system.delete_file(tree.path(f)), gone())
        _each(move, (row for row in tree.lines(files) if row[2] and row[1] == DOCUMENT))
        number = max(tree.commits(), default=0) + 1
        if tree.write_lines(draft, ({"commit": number, "slug": s, "file_name": n} for s, n, folder in tree.lines(files) if folder)):
            tree.system.create_dir(f"{tree.base}/{COMMITS}", recursive=True)
            tree.system.move(draft, f"{tree.base}/{COMMITS}/{number:012d}.json")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        tree = Tree(self.root)
        if tree.system.get_file_info(f"{tree.base}/{self.staging}").type == fs.FileType.Directory:
            tree.system.delete_dir(f"{tree.base}/{self.staging}")


class ExtractionTree(DataSource):
    """Options: path, and ``files``, how many a task reads."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("files", FILES))

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self._size())

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options["path"], self._size())

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("extraction_tree")`` known to a session."""
    small_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ExtractionTree)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files of a tree: slug, file_name, content. An empty root, or none, gives no rows."""
    register(spark)
    return spark.read.format(NAME).load(root)


def follow_tree(spark: SparkSession, root: str) -> DataFrame:
    """Stream of the files that each write of this source changes."""
    register(spark)
    return spark.readStream.format(NAME).load(root)


def tree_documents(files: DataFrame) -> DataFrame:
    """Parsed document.json files. Broken JSON gives null columns."""
    return files.where(F.col("file_name") == DOCUMENT).select("slug", F.from_json("content", schemas.DOCUMENT_JSON).alias("d")).select("d.*", "slug")


def tree_pages(files: DataFrame) -> DataFrame:
    """Parsed page files. Broken JSON gives null columns."""
    return files.where(F.col("file_name") != DOCUMENT).select("slug", "file_name", F.from_json("content", schemas.PAGE_JSON).alias("p")).select("p.*", "slug", "file_name")


def tree_files(pages: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Rows for ``write_tree``: pages by slug and file_name (or page_number, with three digits), documents by slug. Null columns are left out of the JSON."""
    out = []
    if pages is not None:
        name = F.col("file_name") if "file_name" in pages.columns else F.format_string("page_%03d.json", "page_number")
        out.append(pages.select("slug", name.alias("file_name"), F.to_json(F.struct(*[c for c in pages.columns if c not in ("slug", "file_name")])).alias("content")))
    if documents is not None:
        out.append(documents.select("slug", F.lit(DOCUMENT).alias("file_name"), F.to_json(F.struct(*[c for c in documents.columns if c != "slug"])).alias("content")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def write_tree(files: DataFrame, root: str, replace: bool = False) -> None:
    """Merges files into a tree, or with ``replace`` replaces their documents. A file that comes twice is an error, and nothing is written."""
    register(files.sparkSession)
    files.select("slug", "file_name", "content").write.format(NAME).mode("overwrite" if replace else "append").save(root)


def tree_changes(spark: SparkSession, root: str) -> DataFrame:
    """commit, slug, file_name of every file that a write changed."""
    return spark.read.schema("commit long, slug string, file_name string").json(f"{root}/{COMMITS}")
