"""Benchmark passages, dataset manifest and collocations against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import collocations, decontaminate, merkle
from gleanery.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- decontamination -------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(docs, items):
    """Per document (words, hit places, items)."""
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, places, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    places.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((doc, len(w), sorted(places), sorted({str(i) for i in found if i is not None})))
    return out


def places(spans):
    return [p for s in spans for p in range(s["from"], s["to"])]


@pytest.mark.parametrize("shard_words, block_bytes", [(1 << 20, 4 << 20), (70, 400)])
def test_hits_of_shards_and_blocks(frame, shard_words, block_bytes):
    r = random.Random(2)
    some = lambda n: [r.choice("ab") + str(r.randrange(6)) for _ in range(n)]
    passages = [some(r.randint(12, 30)) for _ in range(6)] + [some(2), some(9)]
    rows = []
    for k in range(40):
        text = some(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            text += p[r.randrange(len(p)) :] + r.choice([[], some(3)]) + p
        rows.append((k % 30 if k else None, ", ".join(text).title()))
    rows += [(99, None), (99, ""), (99, "!!"), (7, rows[9][1])]
    items = [(k, " ".join(p)) for k, p in enumerate(passages)] + [(None, "b1 b2 b3"), (3, "a1 a1 a1"), (8, None), (9, "--")]
    index = decontaminate.index_shards(frame(rows, "doc_id long, text string"), shard_words=shard_words)
    got = decontaminate.search(index, frame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    found = sorted((str(r.id), r.n_words, places(r.spans), list(r.items)) for r in got)
    assert found == sorted((str(d), *rest) for d, *rest in hits(rows, items))
    assert all(r.n_hit == len(places(r.spans)) and all(a["to"] < b["from"] for a, b in zip(r.spans, r.spans[1:])) for r in got)


def test_contamination_of_odd_rows(spark, sf, frame, odd_docs, no_docs):
    benchmark = frame([(1, " ".join(f"word{i}" for i in range(20)), 5), (2, "one", 6)], "item_id long, text string, n long")
    rows = decontaminate.contamination(odd_docs, benchmark).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by_id[k].n_hit for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [20, 20, 20, 20, 0, 0, 0, 1, 0]
    assert by_id[1].items_sha256 == sha("1") and by_id[5].items_sha256 == sha("") and by_id[8].n_items == 1
    assert decontaminate.contamination(no_docs, benchmark).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(odd_docs, benchmark.limit(0)).collect())


def test_index_finds_every_occurrence():
    r = random.Random(4)
    for n in (1, 5, 300):
        pieces = [np.array([r.randrange(3) for _ in range(r.randint(0, n))], np.int64) for _ in range(5)]
        row = {k: v.tobytes() for k, v in decontaminate.build_index(pieces, 3).items()}
        index = decontaminate.Index({**row, "n": sum(map(len, pieces)) + 5, "vocabulary": b"x y z"})
        text = [s for p in pieces for s in [*(p + 1).tolist(), 0]]
        for size in (1, 2, 4):
            there = sorted({s for s in text if s})
            windows = np.array([[r.choice(there) for _ in range(size)] for _ in range(20)])
            for w, low, high in zip(windows, *index.find(windows)):
                want = [k for k in range(len(text)) if text[k : k + size] == w.tolist()]
                assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def test_spans_are_cut_from_the_text():
    assert decontaminate.cut_spans("One, two; É3 four!", [{"from": 1, "to": 3}]) == "One,  four!"
    assert decontaminate.cut_spans("one two", [{"from": 0, "to": 1}, {"from": 1, "to": 2}]) == " "
    assert decontaminate.cut_spans("one", []) == "one"


# --- manifest --------------------------------------------------------------


def leaf(row, columns):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*(value(row[c]) for c in columns))


def tree(nodes):
    """Levels of nodes, up to one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[k : k + 16]) for k in range(0, len(now), 16)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at - at % 16 : at - at % 16 + 16]
        out.append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
        at //= 16
    return out


def manifests(rows, columns):
    groups = {}
    for row in rows:
        low = dict(row, text=None if row["text"] is None else row["text"].translate(LOWER))
        tried = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
        groups.setdefault(row["source"], []).append((row["doc_id"], leaf(row, columns), leaf(low if tried else row, columns)))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(tree([x[1] for x in groups[s]]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for at, (doc, own, tried) in enumerate(groups[s]):
            steps = path(trees[k], at) + path(top, k)
            folded = merkle.fold(tried, steps)
            proof = sha(*(x for _, siblings in steps for x in siblings))
            out.append((str(doc), own, trees[k][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out)


COLUMNS = ["doc_id", "source", "lang", "text"]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_of_uneven_sources(frame, levels):
    sizes = {None: 3, "a": 1, "b": 16, "c": 17, "d": 300, "é": 257, "Z": 33, **{f"s{k}": 2 for k in range(20)}}
    rows = [(k * 7 % 1000, s, None if k % 4 else "en", f"Text {k}" if k % 9 else None) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(None, "d", "en", "x"), (None, "d", "en", "x"), (5, "d", "fr", "B"), (5, "d", "fr", "A")]
    docs = frame(rows, "doc_id long, source string, lang string, text string")
    got = merkle.manifest(docs, merkle.fifth(), COLUMNS, levels=levels).collect()
    want = manifests([dict(zip(COLUMNS, r)) for r in rows], COLUMNS)
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_odd_rows(odd_docs, no_docs, frame):
    rows = [r.asDict() for r in odd_docs.select(*COLUMNS).collect()]
    got = merkle.manifest(odd_docs, merkle.fifth(), COLUMNS).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == manifests(rows, COLUMNS)
    assert merkle.manifest(no_docs, merkle.fifth(), COLUMNS).collect() == []
    one = merkle.manifest(frame([(1, "s", "en", "Q")], "doc_id long, source string, lang string, text string"), merkle.fifth(), COLUMNS).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


# --- collocations ----------------------------------------------------------


def grams(docs):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in (1, 2, 3):
                counts.update((lang, *w[k : k + n]) for k in range(len(w) - n + 1))
    return counts, totals


def mined(docs, least, top):
    f, n = grams(docs)
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    rows = []
    for (lang, *w), a in candidates.items():
        inside = [b for k, b in candidates.items() if k[0] == lang and len(k) == 4 and len(w) == 2 and tuple(w) in (k[1:3], k[2:4])]
        if any(100 * b >= 50 * a for b in inside):
            continue
        cuts = [(f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, (left, right) = min(((1_000_000 * a * a // (x * y), (x, y)) for x, y in cuts), key=lambda c: c[0])
        rows.append((lang, score, a, " ".join(w), left, right, n[lang]))
    rows.sort(key=lambda r: (r[0], -r[1], -r[2], r[3].encode()))
    out, ranks = [], Counter()
    for lang, score, a, phrase, left, right, total in rows:
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.append((lang, ranks[lang], phrase, a, left, right, total, score))
    return out


def test_collocations(frame):
    r = random.Random(8)
    word = lambda: r.choice(["New", "york", "the", "of", "ä", "\x00z", "a"]) + r.choice(["", "", "1"])
    rows = [(r.choice(["en", "en", "en", "fr", None, "und"]), "".join(word() + r.choice([" ", " ", "\t", "  ", ". ", "\n", "!?"]) for _ in range(60))) for _ in range(80)]
    rows += [("en", None), ("en", ""), ("xx", "  ..  "), ("yy", "solo")]
    got = collocations.collocations(frame(rows, "lang string, text string"), least=5, top=40).collect()
    assert [tuple(x) for x in sorted(got, key=lambda x: (x.lang, x.rank))] == mined(rows, 5, 40)


def test_collocations_of_odd_rows(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()]
    got = collocations.collocations(odd_docs, least=2).collect()
    assert [tuple(x) for x in sorted(got, key=lambda x: (x.lang, x.rank))] == mined(rows, 2, 2000)
    assert collocations.collocations(no_docs).collect() == []


def test_bursting_spilling_and_cut_texts(monkeypatch):
    """Counts stay whole when containers burst, subtrees are spilled and texts are cut."""
    for name, value in (("BURST", 40), ("PARTS", 4), ("MOST_PHRASES", 400), ("MOST_WORDS", 90), ("SEGMENT", 50)):
        monkeypatch.setattr(collocations, name, value)
    r = random.Random(6)
    docs = [(r.choice(["en", "fr"]), " ".join(r.choice(["w" * 70, *(f"w{r.randrange(12)}{r.choice(',    ')}" for _ in range(60))]) for _ in range(r.randint(0, 200)))) for _ in range(30)]
    docs += [("en", " ".join(f"u{k}" for k in range(300)))]
    batch = pa.RecordBatch.from_arrays([pa.array([d[k] for d in docs], pa.string()) for k in (0, 1)], names=["lang", "text"])
    runs = [x for b in collocations._count(3)(iter([batch])) for x in b.to_pylist()]
    assert len(runs) > 30
    runs.sort(key=lambda x: (x["part"], x["lang"]))
    merged = [x for b in collocations._merge(1)(iter([pa.RecordBatch.from_pylist(runs, collocations._RUN)])) for x in b.to_pylist()]
    counts, totals = grams(docs)
    assert Counter({(x["lang"], *(x[w] for w in ("w1", "w2", "w3") if x[w])): x["f"] for x in merged if x["w1"]}) == counts
    assert sum(x["f"] for x in merged if not x["w1"]) == totals.total()


def test_queries_against_brute_force(spark, sf):
    """The registered queries over whole tables; SQL is held against them elsewhere."""
    docs = table(spark, sf, "documents").collect()
    got = collocations.collocations(table(spark, sf, "documents")).collect()
    assert [tuple(x) for x in sorted(got, key=lambda x: (x.lang, x.rank))] == mined([(d.lang, d.text) for d in docs], 10, 2000)
