import base64
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gleanery.llm import bpe, classifier, mixing, rules, sharding, warc
from gleanery.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_of_random_text(reference):
    r, own = random.Random(1), bpe.Codec(RANKS, public_tokenizers.PATTERN)
    letters = list(" \t\n\r\x0b\x0c\x1c\x85\xa0   　᠎​ abcAB19'sdltrevm,.!?é́ßж中文ñ٣😀👩‍👧²ⅷ")
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        ids = own.encode_batch([text])[0]
        assert ids.tolist() == reference.encode_ordinary(text)
        assert own.decode_bytes(ids) == text.encode()
        starts, ends = own.offsets(text, ids)
        assert all(0 <= s < e <= len(text) for s, e in zip(starts, ends))
        assert b"".join(own.bytes_of[i] for i in ids.tolist()).decode() == text
    with pytest.raises(KeyError):
        own.decode_bytes(np.array([10**7]))


def test_offsets_of_split_characters(reference):
    """The characters of a token are those its bytes lie in, counted byte by byte."""
    own, split = bpe.Codec(RANKS, public_tokenizers.PATTERN), 0
    for text in ("a😀b", "𝔘𝔫𝔦 ᚠᛇᚻ", "é́ 中文😀👩‍👧", "\U0010ffff\u0800x", "naïve"):
        ids = own.encode_batch([text])[0]
        of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
        at, want = 0, []
        for token in ids.tolist():
            size = len(reference.decode_single_token_bytes(token))
            want.append((of_byte[at], of_byte[at + size - 1] + 1))
            at += size
        starts, ends = own.offsets(text, ids)
        assert list(zip(starts.tolist(), ends.tolist())) == want
        split += sum(a[1] > b[0] for a, b in zip(want, want[1:]))
    assert split


def test_offsets_of_split_characters():
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    text = "a 👧 b"
    ids = own.encode_batch([text])[0]
    starts, ends = own.offsets(text, ids)
    inside = [(s, e) for s, e in zip(starts, ends) if s == 2 or e == 3]
    assert len(inside) > 1 and all(e == 3 for _, e in inside)


def test_round_trip(spark, sf, reference, odd_docs, no_docs):
    for docs in (table(spark, sf, "documents"), odd_docs):
        texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = []
        for i, text in texts:
            ids = np.array(reference.encode_ordinary(text), "<u4")
            want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        got = [tuple(r) for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []


def test_encode_and_decode_carry_columns(odd_docs, no_docs):
    both = bpe.decode(bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    for r in both.collect():
        assert r.decoded_text == r.text and r.kept == "kept"
        assert r.text is None or len(r.ids) == len(r.starts) == len(r.ends)
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []


def test_cut_ids_decode_to_bytes(frame, spark):
    ids = bpe.Codec(RANKS, public_tokenizers.PATTERN).encode_batch(["👧"])[0].tolist()
    df = spark.createDataFrame([(ids[:-1],), ([],), (None,)], "ids array<int>")
    a, b, c = bpe.decode(df, RANKS, public_tokenizers.PATTERN).collect()
    assert bytes(a.decoded) == "👧".encode()[: len(a.decoded)] and "�" in a.decoded_text
    assert bytes(b.decoded) == b"" and c.decoded is None


def test_repeated_words():
    def plain(words):
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        return len(twice)

    r = random.Random(2)
    for _ in range(300):
        words = [b"%d" % r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(0, 40))]
        assert rules.repeated_words(words) == plain(words)
    assert rules.repeated_words([b"%d" % (i % 30_000) for i in range(60_000)]) == 60_000


def test_rules_on_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in rules.judge(odd_docs).collect()}
    assert (rows[1].n_words, rows[1].base_failed, rows[1].kept) == (60, False, True)
    assert all(rows[i].base_failed and not rows[i].kept and rows[i].n_words == 0 for i in (5, 6, 7))
    assert rules.judge(odd_docs).count() == odd_docs.count()
    assert rules.judge(no_docs).collect() == []


def test_sketch_quantiles_are_close(spark):
    """A fence of a merged sketch lies within a bin of the exact quartiles."""
    counts = spark.range(5000).selectExpr(
        "id % 7 AS part", "10L AS n_words", "100L AS word_chars", "(id * id) % 97 AS n_symbols", "0L AS n_dup_lines",
        "0L AS n_repeat_words", "1L AS n_lines", "0L AS n_capitals",
    )
    merged = rules.sketch(counts, ["part"]).groupBy("measure", "low", "high").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    row = rules.fences(merged, ["one"]).first()
    values = sorted(100 * (i * i % 97) for i in range(5000))
    exact = min(values[3750 - 1] + rules.REACH * (values[3750 - 1] - values[2500 - 1]) + 500, values[4950 - 1] + 250)
    assert row.rows == 5000 and abs(row.most_symbols - exact) <= exact * 5 / 32


def counted(spark, groups):
    """Counts of documents of 100 words: (source, documents, repeated words each)."""
    rows = [("en", s, 100, 500, n, n // 10, n, 10, n) for s, times, n in groups for _ in range(times)]
    return spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} long" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")))


def test_sources_get_fences_of_their_own(spark):
    """A source without symbols or repeats is held to less than one with some, in every measure that both have."""
    many = [("clean", 2000, 0), ("mixed", 1900, 0), ("mixed", 100, 12)]
    limits = {r.source: r for r in rules.thresholds(counted(spark, many)).collect()}
    for name in ("most_symbols", "most_dup_lines", "most_repeats", "most_capitals"):
        assert limits["clean"][name] < limits["mixed"][name]


def test_fences_do_not_jump_with_the_size_of_a_source(spark):
    """One document more moves a fence little, at every number of documents."""
    found = []
    for n in (1, 98, 99, 100, 101):
        rows = counted(spark, [("other", 3000, 0), ("other", 200, 12), ("small", n, 0)])
        found.append({r.source: r.most_repeats for r in rules.thresholds(rows).collect()}["small"])
    assert found == sorted(found, reverse=True) and found[1] - found[4] < (found[0] - found[4]) / 10


def plain_estimate(rows):
    """Expectation maximisation over rows, a document at a time."""
    total, n = len(rows), len(classifier.HEURISTICS)
    share = [0.95 * 0.2 ** sum(v == classifier.BAD for v in row) for row in rows]
    low = classifier.PRIOR_BAD
    for _ in range(classifier.EM_ROUNDS):
        logs = []
        for mine, start in ((share, [1 + (1 - 2 * low) * classifier.PRIOR_WEIGHT * total] + [1 + low * classifier.PRIOR_WEIGHT * total] * 2),
                            ([1 - x for x in share], [1, 1, 1])):
            chance = []
            for k in range(n):
                mass = [start[v] + sum(m for m, row in zip(mine, rows) if row[k] == v) for v in range(3)]
                chance.append([m / sum(mass) for m in mass])
            logs.append([math.log(sum(mine) + 1) + sum(math.log(chance[k][row[k]]) for k in range(n)) for row in rows])
        new = [1 / (1 + math.exp(min(b - a, 500))) for a, b in zip(*logs)]
        moved = max(abs(a - b) for a, b in zip(new, share))
        share = new
        if moved < 1e-9:
            break
    return share


def test_estimates_equal_those_over_rows():
    r = random.Random(5)
    rows = []
    for _ in range(120):
        bad = r.random() < 0.3
        rows.append([classifier.NEITHER if r.random() < 0.2 else int(bad ^ (r.random() < 0.1)) for _ in classifier.HEURISTICS])
    codes = [int("".join(map(str, row)), 3) for row in rows]
    found = classifier.estimate({c: codes.count(c) for c in codes})
    assert np.abs(found[codes] - plain_estimate(rows)).max() < 1e-6


def test_scores_equal_a_dense_scorer(spark, sf):
    """Sparse fitting and scoring give what the same steps give on a full matrix."""
    docs = table(spark, sf, "documents")
    model = classifier.fit(docs)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    dense = {}
    for i, text in texts.items():
        row = np.zeros(classifier.WIDTH)
        words = text.split()
        np.add.at(row, *classifier.features(words, classifier.measures(text, words), classifier._Places()))
        dense[i] = row
    label = {i: model.posterior[classifier.pattern_of(classifier.measures(t, t.split()))] for i, t in texts.items()}
    x, y = np.stack([dense[i] for i in sorted(texts)]), np.array([label[i] for i in sorted(texts)])
    assert min((y >= 0.5).sum(), (y < 0.5).sum()) > 0 and len(y) <= classifier.SAMPLE
    side = np.where(y >= 0.5, 0.5 / (y >= 0.5).sum(), 0.5 / (y < 0.5).sum())
    w, b, seen, seen_b = np.zeros(classifier.WIDTH), 0.0, np.full(classifier.WIDTH, 1e-8), 1e-8
    for _ in range(classifier.FIT_ROUNDS):
        error = side * (1 / (1 + np.exp(-(x @ w + b))) - y)
        slope = x.T @ error + classifier.RIDGE * w
        seen, seen_b = seen + slope**2, seen_b + error.sum() ** 2
        w, b = w - 0.5 * slope / np.sqrt(seen), b - 0.5 * error.sum() / np.sqrt(seen_b)
    for r in classifier.score(docs, model).collect():
        want = 1 / (1 + math.exp(-(dense[r.doc_id] @ w + b))) if texts[r.doc_id].split() else 0.0
        assert abs(r.score - want) < 1e-6 and r.kept == (want >= classifier.LEAST_SCORE)


def test_model_does_not_depend_on_the_order_of_repeated_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    again = docs.selectExpr("doc_id % 50 AS doc_id", "text")
    one = classifier.fit(docs.union(again).coalesce(1))
    two = classifier.fit(again.union(docs).repartition(7, "text"))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_classifier_on_held_out_labels(spark):
    """Trained on heuristics only; the labels serve to measure."""
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = classifier.score(docs, classifier.fit(docs)).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_expectation_maximisation_finds_accuracies():
    """Votes drawn with known error rates give back the hidden class."""
    r = np.random.default_rng(1)
    good = r.random(20_000) < 0.8
    codes = np.zeros(len(good), np.int64)
    for k in range(len(classifier.HEURISTICS)):
        miss = 0.02 + 0.03 * k
        wrong = r.random(len(good)) < miss
        vote = np.where(good ^ wrong, classifier.GOOD, classifier.BAD)
        vote[r.random(len(good)) < 0.2] = classifier.NEITHER
        codes = codes * 3 + vote
    counts = {int(c): int(n) for c, n in zip(*np.unique(codes, return_counts=True))}
    found = classifier.estimate(counts)[codes] >= 0.5
    assert (found == good).mean() > 0.98


def test_classifier_on_odd_rows(odd_docs, no_docs):
    model = classifier.fit(odd_docs)
    rows = classifier.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.score == 0 and not r.kept for r in rows if r.doc_id in (5, 6, 7))
    assert classifier.keep_good(odd_docs, model).columns == odd_docs.columns
    empty = classifier.fit(no_docs)
    assert classifier.score(no_docs, empty).collect() == []


def test_mix_draws_a_poisson(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id < 15000, 'a', 'b') AS source")
    rows = mixing.mix(docs, {"a": 1.0, "b": 3.0}, total=40_000, seed=7).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in rows}
    assert abs(counts["a"] - 10_000) < 500 and abs(counts["b"] - 30_000) < 800
    drawn = mixing.mix(docs, {"a": 1.0, "b": 3.0}, total=40_000, seed=7).filter("source = 'b' AND copy_no = 1")
    shares = {r.n_copies: r["count"] / 5000 for r in drawn.groupBy("n_copies").count().collect()}
    for k in range(1, 12):
        assert abs(shares.get(k, 0) - np.exp(-6) * 6.0**k / np.prod(np.arange(1.0, k + 1))) < 0.02


def poisson(rate, n):
    """P(X <= k) for k < n, term by term."""
    return np.cumsum([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(n)])


def test_poisson_cdf(spark):
    rates = [0.0, 1e-9, 0.01, 0.5, 3.0, 40.0, 900.0, 20_000.0]
    rows = mixing.poisson_cdf(spark.createDataFrame([(x,) for x in rates], "rate double").selectExpr("rate AS key", "rate"), "key", "rate")
    found = {r.key: (r.first, r.cdf) for r in rows.collect()}
    assert sorted(found) == rates and found[0.0] == (0, [1.0] * 31)
    for rate in rates[1:]:
        first, cdf = found[rate]
        want = poisson(rate, first + len(cdf))[first:]
        assert np.abs(np.array(cdf) - want).max() < 1e-9 and abs(cdf[-1] - 1) < 1e-9


def test_mix_at_a_rate_of_a_million(spark):
    docs = spark.createDataFrame([(1, "rare"), (2, "rare"), (3, "none")], "doc_id long, source string")
    rows = mixing.mix(docs, {"rare": 1.0}, total=2_000_000).groupBy("doc_id").agg(F.max("n_copies").alias("n"), F.count("*").alias("rows"))
    got = {r.doc_id: (r.n, r.rows) for r in rows.collect()}
    cdf = poisson(1e6, 1_010_000)
    for doc_id in (1, 2):
        u = int(hashlib.md5(f"0|{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        want = int(np.searchsorted(cdf, u, side="right"))
        assert got[doc_id] == (want, want)
    assert 3 not in got


def test_mix_repeats_a_rare_source_most(spark):
    """At rates where exp(-rate) is 0.0, counts are still those of the inverted distribution."""
    docs = spark.sql("SELECT id AS doc_id, if(id < 12, NULL, if(id < 20, 'rare', if(id < 50, 'big', 'unwanted'))) AS source FROM range(60)")
    mixed = mixing.mix(docs, {None: 12 * 1000.0, "rare": 8 * 1700.0, "big": 30.0}, total=25_630)
    got = {r.doc_id: r.n_copies for r in mixed.select("doc_id", "n_copies").distinct().collect()}
    for doc_id in range(20):
        rate = 1000.0 if doc_id < 12 else 1700.0
        k = np.arange(3000)
        cdf = np.cumsum(np.exp(k * np.log(rate) - rate - np.array([math.lgamma(x + 1) for x in k])))
        u = int(hashlib.md5(f"0|{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert got[doc_id] == np.sum(cdf <= u) and abs(got[doc_id] - rate) < 6 * rate**0.5
    assert mixed.count() == sum(got.values()) and max(got) < 50


def test_mix_of_odd_rows(odd_docs, no_docs):
    mixed = mixing.mix(odd_docs, seed=3)
    again = mixing.mix(odd_docs, seed=3)
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "copy_no").collect()))
    assert key(mixed) == key(again)
    assert {"copy_no", "n_copies", "position"} <= set(mixed.columns) and "group" in mixed.columns
    assert mixing.mix(no_docs).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, {"nowhere": 1.0}).collect()


def capacity(sizes, shards):
    """Smallest capacity, by trying."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, filled = (low + high) // 2, 1, 0
        for size in sizes:
            if filled + size > middle:
                used, filled = used + 1, 0
            filled += size
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_minimax(spark, sf, shards):
    docs = table(spark, sf, "documents")
    rows = sharding.shard(docs, shards).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    first, sizes = {}, {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
        sizes[first[texts[i]]] = sizes.get(first[texts[i]], 0) + len(texts[i].encode()) + 1
    held, slots, place = {}, {}, {}
    for r in rows:
        held[r.shard] = held.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert place.setdefault(texts[r.doc_id], r.shard) == r.shard
        assert r.law == "bytes" and r.grown_shard is None
    assert max(held.values()) == capacity([sizes[i] for i in sorted(sizes)], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards_of_odd_rows(odd_docs, no_docs, frame):
    rows = sharding.shard(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.size for r in rows if r.doc_id in (5, 6)} == {1}
    assert sharding.shard(no_docs).collect() == []
    hot = frame([(i, "same" if i % 3 else f"text {i}") for i in range(300)], "doc_id long, text string")
    rows = sharding.shard(hot, 4).collect()
    assert len({r.shard for r in rows if r.doc_id % 3}) == 1 and len(rows) == 300


def test_archives(spark, frame):
    page = "<p>" + "some text of a page " * 50
    rows = [(i, f"http://h/{i}", f"{page}{i % 40}") for i in range(200)]
    rows += [(300, None, None), (301, "http://h/ with\r\nspace", ""), (None, "http://n", "alone"), (None, "http://n", page + "7"), (5, "http://h/5", f"{page}5")]
    pages = frame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS n")
    got = warc.archive(pages).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(i, best.get(html or "", -1))
    for r in got:
        if r.page_id is None:
            continue
        html = next((h or "") for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        keeper = best[html]
        assert (r.record_type, r.refers_to) == (("response", None) if keeper == r.page_id else ("revisit", keeper))
    assert {(r.record_type, r.refers_to) for r in got if r.page_id is None} == {("response", None), ("revisit", 167)}
    assert warc.archive(pages.limit(0)).collect() == []
    small = warc.archive(pages, least_bytes=10**9).collect()
    assert {r.record_type for r in small} == {"response"}


def test_archives_hold_the_payloads(spark, sf):
    pages = table(spark, sf, "pages")
    written = warc.write_archives(pages)
    back = {int(r.page_id): r for r in warc.read_archives(written).collect()}
    for r in pages.collect():
        if back[r.page_id].payload is not None:
            assert bytes(back[r.page_id].payload).decode() == r.html
    assert written.agg({"n_bytes": "sum"}).first()[0] < sum(len(r.html.encode()) for r in pages.collect())


def test_record_round_trip():
    fields, block = warc.parse(warc.record("7", "http://a/ü b", b"x\r\n\r\ny", None))
    assert fields["X-Page-Id"] == "7" and block.partition(b"\r\n\r\n")[2] == b"x\r\n\r\ny"
    fields, block = warc.parse(warc.record(None, None, b"abc", "9"))
    assert fields["WARC-Type"] == "revisit" and fields["X-Refers-To-Page-Id"] == "9" and block.endswith(b"\r\n\r\n")
