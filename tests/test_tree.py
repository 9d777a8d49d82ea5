import json
import pickle
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfolio.sources import corpus, tree


@pytest.fixture
def root(spark, tmp_path):
    (tmp_path / "_notes" / "pages").mkdir(parents=True)
    for slug, pages in (("first", 12), ("zweite ä", 3), ("empty", 0)):
        (tmp_path / slug / "pages").mkdir(parents=True)
        (tmp_path / slug / "document.json").write_text(json.dumps({"source_file": f"{slug}.pdf", "total_pages": pages, "mine": [1, {"a": None}]}, indent=2))
        for n in range(1, pages + 1):
            element = {"type": "figure", "label": f"Fig. {n}", "bbox": [1, 2.5, 3, 4], "odd": n}
            (tmp_path / slug / "pages" / f"page_{n:03d}.json").write_text(json.dumps({"page_number": n, "text": f"Page {n} of {slug}", "elements": [element], "extra": "kept"}, indent=2))
    (tmp_path / "first" / "pages" / "page_x.json").write_text("{broken")
    (tmp_path / "first" / "pages" / "other.txt").write_text("no page")
    return str(tmp_path)


def rows(frame):
    return sorted((json.dumps(r.asDict(True), sort_keys=True) for r in frame.collect()))


def times(root):
    from pathlib import Path

    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).glob("[!_]*/**/*.json")}


def test_reads_what_the_file_sources_read(spark, root):
    files = tree.read_tree(spark, root)
    assert rows(tree.tree_pages(files)) == rows(corpus.read_pages(spark, root))
    assert rows(tree.tree_documents(files)) == rows(corpus.read_documents(spark, root))
    assert tree.read_tree(spark, root + "/nowhere").count() == 0


def test_many_pages_are_many_partitions_and_slugs_prune(spark, root):
    tree.register(spark)
    files = spark.read.format(tree.NAME).option("files", 5).load(root)
    assert files.rdd.getNumPartitions() == 4  # 19 files
    one = files.where("slug = 'zweite ä'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 4
    assert files.where("slug IN ('empty', 'none') AND file_name LIKE 'doc%'").count() == 1
    assert files.where("slug = 'first' AND slug = 'empty'").count() == 0


def test_round_trip(spark, root, tmp_path):
    copy = f"{tmp_path}/_copy"
    files = tree.read_tree(spark, root).where("content != '{broken'")
    tree.write_tree(tree.tree_files(tree.tree_pages(files), tree.tree_documents(files)), copy)
    assert rows(tree.tree_pages(tree.read_tree(spark, copy))) == rows(tree.tree_pages(files))
    assert rows(tree.tree_documents(tree.read_tree(spark, copy))) == rows(tree.tree_documents(files))
    assert rows(corpus.read_pages(spark, copy)) == rows(tree.tree_pages(files))


def test_enrichment_rewrites_what_it_changes_alone(spark, root):
    before, pages = times(root), tree.tree_pages(tree.read_tree(spark, root)).where("page_number IS NOT NULL")
    rich = pages.withColumn("summary", F.when(F.col("page_number") == 2, F.concat(F.lit("On "), "slug")))
    tree.write_tree(tree.tree_files(rich), root)
    after = times(root)
    assert {k for k in after if after[k] != before.get(k)} == {"first/pages/page_002.json", "zweite ä/pages/page_002.json"}
    with open(f"{root}/first/pages/page_002.json") as f:
        page = json.load(f)
    assert page["extra"] == "kept" and page["elements"][0]["odd"] == 2 and page["summary"] == "On first"
    assert rows(tree.tree_pages(tree.read_tree(spark, root).where("content != '{broken'"))) == rows(rich)
    tree.write_tree(tree.tree_files(rich), root)
    assert times(root) == after and rows(tree.tree_changes(spark, root).select("commit")) == ['{"commit": 1}'] * 2


def test_replacing_a_document_leaves_others(spark, root):
    before = times(root)
    pages = spark.createDataFrame([("first", 1, "new text")], "slug string, page_number int, text string")
    tree.write_tree(tree.tree_files(pages), root, replace=True)
    after = times(root)
    assert {k for k in after if k.startswith("first/")} == {"first/document.json", "first/pages/page_001.json"}
    assert {k: v for k, v in after.items() if not k.startswith("first/")} == {k: v for k, v in before.items() if not k.startswith("first/")}
    with open(f"{root}/first/pages/page_001.json") as f:
        assert json.load(f) == {"page_number": 1, "text": "new text"}


@pytest.mark.parametrize("bad", [[("first", 1), ("first", 1)], [("a", 1), ("../b", 1)], [("a", 1), (None, 1)], [("a", 1), ("_a", 2)]])
@pytest.mark.parametrize("replace", [False, True])
def test_a_failed_write_leaves_the_tree(spark, root, bad, replace):
    from pathlib import Path

    before = times(root)
    pages = spark.createDataFrame([(s, n, "t") for s, n in bad], "slug string, page_number int, text string").repartition(2)
    with pytest.raises(Exception, match="more than once|no file of an extraction tree"):
        tree.write_tree(tree.tree_files(pages), root, replace)
    assert times(root) == before and not list(Path(root).glob("_staging*")) and not list(Path(root).glob("_commits/*"))


def test_an_empty_write_changes_nothing(spark, root):
    before = times(root)
    for replace in (False, True):
        tree.write_tree(tree.tree_files(spark.createDataFrame([], "slug string, page_number int, text string")), root, replace)
    assert times(root) == before


def test_stream_gives_what_changed_over_restarts(spark, tmp_path):
    root, out = f"{tmp_path}/tree", f"{tmp_path}/out"

    def write(*pages):
        tree.write_tree(tree.tree_files(spark.createDataFrame(pages, "slug string, page_number int, text string")), root)

    def follow():
        stream = tree.follow_tree(spark, root).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", out)
        stream.trigger(availableNow=True).start().awaitTermination()
        return sorted((r["slug"], r["file_name"], json.loads(r["content"])["text"]) for r in spark.read.parquet(out).collect())

    write(("a", 1, "one"), ("b", 1, "two"))
    assert follow() == [("a", "page_001.json", "one"), ("b", "page_001.json", "two")]
    write(("a", 1, "one"), ("a", 2, "three"))
    write(("b", 1, "changed"))
    assert follow() == [("a", "page_001.json", "one"), ("a", "page_002.json", "three"), ("b", "page_001.json", "changed"), ("b", "page_001.json", "two")]
    assert follow() == follow()
    latest = {(s, n) for s, n, _ in follow()}
    assert latest == {(r["slug"], r["file_name"]) for r in tree.read_tree(spark, root).collect()}


def test_a_task_holds_a_slice_of_its_texts(tmp_path, monkeypatch):
    rows = pa.record_batch({"slug": ["s"] * 64, "file_name": [f"page_{i}.json" for i in range(64)], "content": [f"{i} " + "x" * (1 << 18) for i in range(64)]})
    monkeypatch.setattr(tree, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)))
    tracemalloc.start()
    done = tree.TreeWriter(str(tmp_path), True).write(iter([rows]))
    wrote = tracemalloc.get_traced_memory()[1]
    files = list(done.changed)
    assert len(files) == 64
    tree.TreeWriter(str(tmp_path), True).commit([done])
    tracemalloc.reset_peak()
    found = [(b.nbytes, b.num_rows) for b in tree._contents(str(tmp_path), files)]
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for _, n in found) == 64 and sum(size for size, _ in found) > 16 << 20
    assert wrote < 6 << 20 and read < 6 << 20


def task_writes(root, monkeypatch, tasks, replace=False):
    """A writer, and what each of its tasks tells it, of lists of (slug, file_name, content)."""
    writer, messages = tree.TreeWriter(root, replace), []
    for number, files in enumerate(tasks):
        monkeypatch.setattr(tree, "TaskContext", SimpleNamespace(get=lambda n=number: SimpleNamespace(partitionId=lambda: n, taskAttemptId=lambda: n)))
        messages.append(writer.write(iter([pa.record_batch(list(map(list, zip(*files))), ["slug", "file_name", "content"])])))
    return writer, messages


def test_the_driver_holds_few_names(tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "NAMES", 500, raising=False)
    monkeypatch.setattr(tree, "LIST_BYTES", 1 << 12, raising=False)
    names = [("many" if i % 2 else "more", f"page_{i:09d}.json") for i in range(10_000)]
    writer, messages = task_writes(str(tmp_path), monkeypatch, [[(*f, "{}") for f in names[n::4]] for n in range(4)])
    assert sum(len(pickle.dumps(m)) for m in messages) < 4000
    tracemalloc.start()
    writer.commit(messages)
    committed = tracemalloc.get_traced_memory()[1]
    partitions = tree.TreeReader(str(tmp_path), 1000).partitions()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert [f for p in partitions for f in p.files] == sorted(names) == list(tree.Tree(str(tmp_path)).changed(0, 1))
    assert committed < 3 << 20 and sum(len(pickle.dumps(p)) for p in partitions) < 10 * len(names) and held < 1 << 20
    assert not list(tmp_path.glob("_staging*"))


def test_lists_are_merged_in_rounds(tmp_path, monkeypatch):
    for name, value in (("NAMES", 2), ("LISTS", 2), ("LIST_BYTES", 7)):
        monkeypatch.setattr(tree, name, value)
    root, page = str(tmp_path), "page_{}.json".format
    first = [[(s, page(i), f'{{"n": {i}}}') for s in ("b", "ä\n", "a") for i in range(n, 9, 3)] for n in range(3)]
    writer, messages = task_writes(root, monkeypatch, [*first, [("a", "document.json", "{}")]])
    writer.commit([*messages, None])
    written = sorted((s, n) for files in [*first, [("a", "document.json", "")]] for s, n, _ in files)
    writer, messages = task_writes(root, monkeypatch, [[("a", page(0), '{"n": 0}'), ("a", page(1), '{"n": 7}')], [("c", page(1), "{}")]])  # one says the same
    writer.commit(messages)
    at = tree.Tree(root)
    assert list(at.changed(0, 1)) == written and list(at.changed(1, 2)) == [("a", page(1)), ("c", page(1))] and list(at.changed(0, 2)) == sorted({*written, ("c", page(1))})
    assert [f for p in tree.TreeReader(root, 4).partitions() for f in p.files] == sorted({*written, ("c", page(1))})
    again = [[("b", page(n), "{}") for n in (5, 1, 3, 1)], [("b", page(n), "{}") for n in (3, 3, 2)], [("a", page(2), "{}")]]
    writer, messages = task_writes(root, monkeypatch, again, replace=True)
    with pytest.raises(ValueError, match="^2 files come more than once, b/page_1.json for one"):
        writer.commit(messages)
    assert at.commits() == [1, 2] and at.read(("b", page(1))) == b'{"n": 1}'
    writer, messages = task_writes(root, monkeypatch, [[("b", page(n), "{}") for n in (8, 2)], [("b", page(9), "{}")]], replace=True)
    writer.commit(messages)
    assert at.files("b") == [("b", page(n)) for n in (2, 8, 9)] and len(at.files("a")) == 10 and not list(tmp_path.glob("_staging*"))
