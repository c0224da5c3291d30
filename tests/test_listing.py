"""Listings against the files that are there."""

import os

import pytest
from pyspark.sql import functions as F

from gleanery.sources import listing, readers

NAMES = ["_x", "a/_y.bin", "a/empty", "a/b/c d%20e.txt", "a/b/é.TXT", "ab/c", "deep/1/2/3/4/z.bin", "plain.json", "a/b/q#?.txt"]
HIDDEN = [".h", "a/.h", ".d/x", "a/.d/b/x"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("objects")
    for k, name in enumerate(NAMES + HIDDEN):
        os.makedirs(base / os.path.dirname(name), exist_ok=True)
        (base / name).write_bytes(b"" if name.endswith("empty") else b"x" * (k + 1))
    return str(base)


def sizes(root, names):
    return {n: os.path.getsize(f"{root}/{n}") for n in names}


@pytest.mark.parametrize("folders", [1, 3, 256])
def test_every_object_is_listed_once(spark, root, folders, monkeypatch):
    monkeypatch.setattr(listing, "FOLDERS", folders)
    rows = listing.listing(spark, root).collect()
    assert {r.name: r.size_bytes for r in rows} == sizes(root, NAMES) and len(rows) == len(NAMES)
    assert all(abs(r.modified_at.timestamp() - os.path.getmtime(f"{root}/{r.name}")) < 1 for r in rows)


@pytest.mark.parametrize("prefix", ["", "a", "a/", "a/b", "a/b/c d", "_", "deep/1/2/3/4/z", "none", "a/.d"])
def test_prefix(spark, root, prefix):
    rows = readers.list_objects(spark, root, prefix=prefix).collect()
    assert {r.name: r.size_bytes for r in rows} == sizes(root, [n for n in NAMES if n.startswith(prefix)])


def test_one_level_suffixes_and_limit(spark, root):
    assert sorted(r.name for r in readers.list_objects(spark, root, recursive=False).collect()) == ["_x", "plain.json"]
    found = readers.list_objects(spark, root, suffixes=[".txt"], max_results=2).collect()
    assert [r.name for r in found] == sorted(n for n in NAMES if n.lower().endswith(".txt"))[:2]
    assert readers.list_objects(spark, f"{root}/absent").collect() == []


def test_reader_splits_by_folder(root):
    reader = listing._Reader({"root": f"file://{root}", "prefix": "a/b/"})
    parts = [p.path[len(root) :] for p in reader.partitions()]
    assert parts == ["", "/a", "/a/b"]
    many = listing._Reader({"root": f"file://{root}"})
    batches = [b for p in many.partitions() for b in many.read(p)]
    assert sorted(n for b in batches for n in b.column("name").to_pylist()) == sorted(NAMES)


def test_content_is_read_in_small_batches(spark, root, monkeypatch):
    monkeypatch.setattr(listing, "BATCH_BYTES", 4)
    files = listing.listing(spark, root).withColumn("name", F.when(F.col("name") == "_x", F.lit("gone")).otherwise(F.col("name")))
    got = {r.name: r.content for r in listing.with_content(files, root).collect()}
    assert got.pop("gone") is None
    assert {n: len(c) for n, c in got.items()} == sizes(root, [n for n in NAMES if n != "_x"])


def test_a_folder_of_any_size_is_listed_in_little_memory(tmp_path):
    import tracemalloc

    from gleanery.sources.listing import _Folder, _Reader

    folder = tmp_path / "many"
    (folder / "deep").mkdir(parents=True)
    for k in range(30_000):
        (folder / f"object-{k}").touch()
    (folder / "deep" / "last").write_text("abc")
    reader = _Reader({"root": f"file://{tmp_path}"})
    tracemalloc.start()
    names, sizes = set(), 0
    for batch in reader.read(_Folder(str(tmp_path), True)):
        tracemalloc.reset_peak() if not names else None
        names.update(range(len(names), len(names) + batch.num_rows))
        sizes += sum(batch.column("size_bytes").to_pylist())
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(names) == 30_001 and sizes == 3 and held < 6 << 20
    assert list(reader.read(_Folder(str(tmp_path / "absent"), True))) == []
