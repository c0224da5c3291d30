import os
import random
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from gleanery import session
from gleanery.llm import exact_dedup, line_dedup, links, near_dedup, queries, substrings
from gleanery.llm.common import table
from tests.llm import brute


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def families(frame):
    """Near copies of one text, texts round one passage, passages alone, short texts."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    base, passage, rows = some(120), some(60), []
    for _ in range(30):
        text = list(base)
        for _ in range(r.randint(0, 6)):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append(" ".join(text))
    rows += [" ".join(some(r.randint(5, 40)) + passage + some(r.randint(5, 40))) for _ in range(25)]
    rows += [" ".join(passage[: r.randint(52, 60)] + some(r.randint(0, 3))) for _ in range(20)]
    rows += [" ".join(some(r.randint(0, 8))) for _ in range(15)] + [rows[3]] * 4 + ["", None, "One", "one"]
    r.shuffle(rows)
    return frame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize("short", [2, links.SHORT])
def test_near_copies_of_families(families, short, monkeypatch):
    for name in ("candidates", "settle"):
        monkeypatch.setattr(links, name, partial(getattr(links, name), short=short))
    monkeypatch.setattr(links, "SHORT", short)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_copies(families, width=4).collect()}
    assert got == brute.near(pairs(families), 4)


@pytest.mark.parametrize("width", [4, 5])
def test_near_copies_of_documents(spark, sf, width):
    docs = table(spark, sf, "documents")
    rows = near_dedup.near_copies(docs, width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near(pairs(docs), width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_copies_of_odd_rows(odd_docs, no_docs):
    rows = near_dedup.near_copies(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {i: by_id[i].component_id for i in (1, 2, 3, 4, 9, 10)} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, 10: 9}
    assert all(by_id[i].kept and by_id[i].n_shingles == 0 for i in (5, 6, 7))
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_dedup.near_copies(no_docs).collect() == []
    assert near_dedup.drop_near_copies(odd_docs).columns == odd_docs.columns


def test_components(frame):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(1, 200)]
    edges += [(2000 + k, 2001 + k) for k in range(60)]
    groups = brute.Union({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    rows = links.components(frame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert len(rows) == len(linked)
    assert {r.node: r.component for r in rows} == {x: groups.find(x) for x in linked}
    assert links.components(frame([], "a long, b long")).collect() == []


def test_exact_copies(spark, sf, odd_docs, no_docs):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.mark_copies(docs).collect()}
    assert got == brute.exact(pairs(docs))
    rows = exact_dedup.mark_copies(odd_docs).collect()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by_id[3].keep_id, by_id[3].group_size, by_id[3].kept) == (1, 3, False)
    assert (by_id[6].keep_id, by_id[5].kept, by_id[7].keep_id) == (5, True, 7)
    assert sorted(r.kept for r in rows if r.doc_id == 8) == [False, True]
    assert [r.keep_id for r in rows if r.doc_id is None and r.group_size == 3] == [1]
    assert exact_dedup.mark_copies(no_docs).collect() == []


def test_drop_exact_copies(odd_docs, no_docs):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 7, 8, 9, 10, 11, 12]
    assert exact_dedup.drop_copies(no_docs).collect() == []


def test_colliding_chunk_fingerprints(spark, sf):
    """With a fingerprint of a few values, identifiers must come from the characters."""
    docs = table(spark, sf, "documents")
    weak = lambda c: F.length(c).cast("long") % 3
    rows = exact_dedup.mark_copies(docs, fingerprint=weak).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in rows} == brute.exact(pairs(docs))


def test_chunks_join_to_the_text(spark):
    texts = ["", "a", "x" * 9000, "One. " * 3000, "é😀 " * 4000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", exact_dedup.chunks_of(F.col("t")).alias("c")).collect():
        assert "".join(r.c) == r.t
        assert all(len(c) <= exact_dedup.MOST_CHUNK for c in r.c)


@pytest.mark.parametrize("short", [2, line_dedup.SHORT])
def test_fuzzy_lines(frame, short, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHORT", short)
    r = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(20, 40))] for _ in range(4)]
    rows = []
    for _ in range(40):
        lines = []
        for _ in range(r.randint(1, 3)):
            line = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                line[r.randrange(len(line))] = r.choice(words)
            lines.append(" ".join(line) + r.choice(["", ".", "!", "  "]))
        lines += ["short line", "A b, c d e", "", " ".join(["junk"] * r.randint(5, 20))]
        r.shuffle(lines)
        rows.append("\n".join(lines))
    docs = frame(list(enumerate([*rows, None, "", rows[0]])), "doc_id long, text string")
    want = brute.fuzzy_lines(pairs(docs))
    got = {x.doc_id: x.removed for x in line_dedup.fuzzy_lines(docs).collect()}
    assert got == {i: want.get(i, []) for i, _ in pairs(docs)}
    for x, text in ((x, dict(pairs(docs))[x.doc_id]) for x in line_dedup.drop_fuzzy_lines(docs).collect()):
        left = None if text is None else "\n".join(line for n, line in enumerate(text.split("\n")) if n not in got[x.doc_id])
        assert x.text == left


def test_fuzzy_lines_of_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in line_dedup.fuzzy_lines(odd_docs).collect() if r.doc_id is not None}
    assert (rows[1].removed, rows[2].removed, rows[5].n_lines, rows[6].n_lines) == ([], [0], 0, 1)
    assert line_dedup.fuzzy_lines(odd_docs).count() == odd_docs.count()
    assert line_dedup.drop_fuzzy_lines(odd_docs).columns == odd_docs.columns
    assert line_dedup.fuzzy_lines(no_docs).collect() == []


@pytest.mark.parametrize("short", [2, line_dedup.SHORT])
def test_similar_lines(spark, frame, short, monkeypatch):
    """Every line that is not empty takes part, and edit similarity alone decides."""
    monkeypatch.setattr(line_dedup, "SHORT", short)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x5E00)) for _ in range(n))
    rows = ["Home | About", "HOME, about!", "...", None, "", "Home\nHome\n\nhome", "ab cdefgh", "xb cdefgh", "ab cdefghi"]
    for size in (3, 10, 20, 50, 100):
        for _ in range(6):
            line = [word() for _ in range(size)]
            near, far = list(line), list(line)
            near[r.randrange(size)] = word()
            for k in r.sample(range(size), size // 3):
                far[k] = word()
            rows.append("\n".join(" ".join(x) for x in (line, near, far)))
    for size in (5, 30, 80):
        text = han(size)
        rows += [text, text, text[: size // 2] + han(1) + text[size // 2 + 1 :], text[1:]]
    docs = frame(list(enumerate(rows)), "doc_id long, text string")
    want = brute.similar_lines(pairs(docs))
    got = {x.doc_id: x.removed for x in line_dedup.similar_lines(docs).collect()}
    assert got == {i: want.get(i, []) for i, _ in pairs(docs)}
    assert got[1] == [0] and got[5] == [1, 3] and got[8] == [0] and got[7] == []
    left = {x.doc_id: x.text for x in line_dedup.drop_similar_lines(docs).collect()}
    assert (left[1], left[3], left[5]) == ("", None, "Home\n")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    assert {x.doc_id: x.removed for x in queries.op8_fuzzy_lines(spark, "").collect()} == got


def test_similar_texts_are_compared_without_their_common_ends(spark, frame):
    """The verdict is that of the whole texts, and a long line with an edit takes no time by its square."""
    r = random.Random(2)
    rows = [("", "a"), ("a", "b"), ("aaaaaaaaaa", "aaaaaaaaaaa"), ("aaaaaaaaaaa", "aaaaaaaaaa"), ("é😀" * 20, "é😀" * 19 + "é"), ("abcdefghij", "bcdefghij")]
    for _ in range(300):
        a = "".join(r.choice("abé ") for _ in range(r.randint(1, 120)))
        b = list(a)
        for _ in range(r.randint(0, 1 + len(a) // 6)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = r.choice(["", "x", "😀"])
        rows.append((a, "".join(b)))
    pairs_ = [(i, i + 10_000, a, b, len(a), len(b)) for i, (a, b) in enumerate(rows)]
    allowed = [max(na, nb) // 10 for *_, na, nb in pairs_]
    df = frame(pairs_, "a long, b long, ta string, tb string, na int, nb int")
    plain = {x.a: x.d for x in df.select("a", F.levenshtein("ta", "tb").alias("d")).collect()}
    texts = df.selectExpr("a AS id", "ta AS norm").union(df.selectExpr("b", "tb"))
    got = {x.a for x in line_dedup._similar(texts, df.select("a", "b", "na", "nb")).collect()}
    assert got == {i for i, d in plain.items() if d <= allowed[i]}
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(200_000))
    start = time.time()
    near = frame([(1, 2, len(long), len(long) + 4)], "a long, b long, na int, nb int")
    assert line_dedup._similar(frame([(1, long), (2, long[:600_000] + " end" + long[600_000:])], "id long, norm string"), near).count() == 1
    assert time.time() - start < 60


def test_what_leaves_pairs_out_keeps_every_similar_one(frame):
    """Letters, their counts cut off, and texts in short bound the distance from below, at its limit too."""
    r, rows = random.Random(6), []
    for k in range(200):
        letters = ["cdghlmprsuv", "abcdefghijklmnopqrstuvwxyz é字", "sz"][k % 3]
        a = [r.choice(letters) for _ in range(r.randint(10, 400))]
        b = list(a)
        for at in r.sample(range(len(a)), len(a) // 10 + r.choice([-1, 0, 0, 1])):
            b[at] = r.choice(["", "", "s", "xs", "q"]) if k % 2 else r.choice("sq字")
        rows.append(("".join(a), "".join(b)))
    rows += [("s" * 6000, "s" * 6400), ("s" * 6000, "s" * 6700), ("ab" * 1500, "ab" * 1500 + "c" * 300), ("s" * 4500, "z" * 451 + "s" * 4499)]
    pairs_ = [(i, i + 10_000, a, b, len(a), len(b)) for i, (a, b) in enumerate(rows)]
    df = frame(pairs_, "a long, b long, ta string, tb string, na int, nb int")
    plain = {x.a: x.d for x in df.select("a", F.levenshtein("ta", "tb").alias("d")).collect()}
    texts = df.selectExpr("a AS id", "ta AS norm").union(df.selectExpr("b", "tb"))
    got = {x.a for x in line_dedup._similar(texts, df.select("a", "b", "na", "nb")).collect()}
    assert got == {i for i, _, _, _, na, nb in pairs_ if plain[i] <= max(na, nb) // 10}
    assert 60 < len(got) < 200 and {200, 202, 203} <= got and 201 not in got


def test_pairs_of_lists_are_left_out_by_their_facts(frame):
    """Only pairs that fit are verified, in short lists and in long ones."""
    entries = frame([(k, i, 1 + i % 3) for k, n in ((0, 6), (1, 30)) for i in range(100 * k, 100 * k + n)], "key long, id long, size int")
    near = links.lists(entries.select("key", "id")).join(entries, ["key", "id"]).withColumn("facts", F.struct("size")).drop("size")
    fits = "x.facts.size = y.facts.size"
    found = {(p.a, p.b) for p in links.candidates(near.filter("key = 0"), 8, fits).collect()}
    assert found == {(0, 3), (1, 4), (2, 5)}
    asked = []

    def verify(pairs):
        asked.extend((p.a, p.b) for p in pairs.collect())
        return pairs

    groups = links.settle(near, frame([(100, 103)], "a long, b long"), verify, 8, fits)
    assert asked and all((a - b) % 3 == 0 for a, b in asked)
    assert {g.node: g.component for g in groups.collect()} == {i: 100 + (i - 100) % 3 for i in range(100, 130)}


def test_long_lines_with_random_edits_share_a_key(frame):
    """Every tenth character changed at random: with n-grams alone 0.78 of such pairs met."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9)))
    rows = []
    for k in range(300):
        text = " ".join(word() for _ in range(r.randint(30, 90)))
        edited = list(text)
        for i in r.sample(range(len(text)), len(text) // 10):
            edited[i] = r.choice("abcdefghijklmnop")
        rows += [(2 * k, text), (2 * k + 1, "".join(edited))]
    lines = line_dedup._all_lines(frame(rows, "doc_id long, text string"), "doc_id", "text")
    of = {x.at: x.doc_id for x in lines.select("at", "doc_id").collect()}
    keys = {of[x.at]: set(x["keys"]) for x in line_dedup._sketched(lines).collect()}
    met = sum(not keys[2 * k].isdisjoint(keys[2 * k + 1]) for k in range(300))
    assert met >= 270
    assert sum(not keys[2 * k].isdisjoint(keys[2 * k + 2]) for k in range(299)) == 0


def test_op8_takes_short_and_unspaced_lines(spark, frame, monkeypatch):
    unspaced = "".join(chr(0x4E00 + 37 * k % 4001) for k in range(40))
    rows = ["Home", "home!", "--", "--", unspaced, unspaced, unspaced[:20] + "字" + unspaced[21:]]
    docs = frame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = {x.doc_id: x.removed for x in queries.op8_fuzzy_lines(spark, "").collect()}
    assert got == {0: [], 1: [0], 2: [], 3: [], 4: [], 5: [0], 6: [0]}


def test_similar_lines_leave_nothing_behind_and_take_lots(spark, frame, monkeypatch):
    """Intermediate tables and shuffle files go as soon as nothing reads them; texts are compared in several lots."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    rows = []
    for size in [15, 25, 40] * 12:
        line = [word() for _ in range(size)]
        rows += [" ".join(line), " ".join([*line[:-1], word()]), " ".join(line[1:])]
    docs = frame(list(enumerate(rows)), "doc_id long, text string")
    made, lots, compared = [], [], line_dedup._compared
    monkeypatch.setattr(line_dedup, "FEW", 2000)
    monkeypatch.setattr(line_dedup, "_compared", lambda *x: lots.append(1) or compared(*x))
    monkeypatch.setattr(session, "scratch_path", lambda s, n, f=session.scratch_path: made.append(f(s, n)) or made[-1])
    listed = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {x.split("/shuffle_")[1].split("_")[0] for x in map(str, listed(blocks.getAllFiles())) if "/shuffle_" in x}
    before, setting = shuffles(), spark.conf.get(session._CLEANUP, None)
    found = line_dedup.similar_lines(docs)
    for _ in range(50):  # Spark removes them in a thread of its own
        if len(shuffles() - before) <= 3:
            break
        time.sleep(0.1)
    # Those of a few small questions to a table stay; there are some 50 shuffles in all.
    assert len(shuffles() - before) <= 3 and spark.conf.get(session._CLEANUP, None) == setting
    assert len(made) > 10 and [p.rsplit("/", 1)[1][:13] for p in made if os.path.exists(p.removeprefix("file:"))] == ["removed_lines"]
    assert len(lots) > 2
    want = brute.similar_lines(pairs(docs))
    assert {x.doc_id: x.removed for x in found.collect()} == {i: want.get(i, []) for i, _ in pairs(docs)}


@pytest.mark.parametrize("parts", ["4", "40"])
def test_repeated_strings(spark, frame, parts):
    r = random.Random(7)
    some = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passages, rows = [some(r.randint(95, 300)) for _ in range(5)], []
    for _ in range(60):
        text = some(r.randint(0, 200))
        for _ in range(r.randint(0, 3)):
            part = r.choice(passages)
            text += part[r.randint(0, 50) : len(part) - r.randint(0, 50)] + some(r.randint(0, 80))
        rows.append(text)
    rows += ["x" * n for n in (50, 99, 100, 101, 500)] + ["xy" * 200, "yx" * 100, None, "", rows[4], rows[4], rows[5] + "z"]
    docs = frame(list(enumerate(rows)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.drop_repeats(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute.substrings(pairs(docs))


def test_long_texts_are_cut_into_blocks(monkeypatch):
    """Suffixes of a text taken in blocks hold the same windows."""
    import numpy as np

    data = np.frombuffer(("abc def " * 90 + "é" * 200 + "xyz " * 100).encode(), np.uint8)
    covered = lambda: sorted(w for _, _, f, n in substrings.named_suffixes(data) for a, c in zip(f, n) for w in range(a, a + c))
    whole = covered()
    monkeypatch.setattr(substrings, "BLOCK", 150)
    assert covered() == whole == list(range(len(data) - substrings.LENGTH + 1))


def test_repeated_strings_of_odd_rows(odd_docs, no_docs):
    rows = substrings.drop_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by_id[1].n_removed, by_id[5].n_bytes, by_id[12].n_spans, by_id[12].n_removed) == (0, 0, 1, 4999)
    # Rows without an id come last, so they change nothing for the others.
    want = brute.substrings({i: t for i, t in pairs(odd_docs) if i is not None}.items())
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id.items()} == want
    assert substrings.drop_repeats(no_docs).collect() == []
