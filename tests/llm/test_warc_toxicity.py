"""Archives and their index, toxicity, and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearc.llm import common, toxicity, warc


@pytest.fixture(scope="module")
def page_rows():
    body = ["<p>one</p>", "<p>zwei é</p>", "x" * 200_000, ""]
    urls = ["http://www.example.org/a?b=1", "https://Example.org:8080/a", "http://example.org", None, "no scheme/path", "http://sub.example.org/é\nline"]
    rows = [(i, urls[i % 6], body[i % 4]) for i in range(40)]
    return [*rows, (50, "http://z.net/", None), (None, "http://n.net/", "<p>one</p>"), (51, "http://u.net/", "unique"), (52, None, None)]


@pytest.fixture(scope="module")
def pages(spark, page_rows):
    return spark.createDataFrame([(*r, "x", "x") for r in page_rows], "page_id long, url string, html string, payload string, digest string").repartition(3)


def want(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and first[h or ""] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def test_archives(pages, page_rows):
    captures = warc.write_archives(pages)
    got = warc.read_records(captures)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == want(page_rows)
    stored = {r.page_id: bytes(r.payload).decode() for r in got.where("record_type = 'response' and page_id is not null").collect()}
    assert all(stored[i] == (h or "") for i, _, h in page_rows if i in stored)
    index = warc.CaptureIndex(warc.write_index(captures, block_lines=3))
    for url in {u for _, u, _ in page_rows}:
        found = index.captures(url)
        same = [i for i, u, _ in page_rows if warc.url_key(u) == warc.url_key(url)]
        assert sorted((c["page_id"] for c in found), key=str) == sorted(same, key=str)
        for c in found:
            assert index.payload(c)["page_id"] == c["page_id"]
    assert index.captures("http://absent.net/") == []


def test_archives_threshold(pages, page_rows):
    got = warc.read_records(warc.write_archives(pages, least=15)).where("record_type = 'revisit'").collect()
    assert {r.payload_bytes for r in got} == {200_000}


def test_archives_of_nothing(pages):
    captures = warc.write_archives(pages.limit(0))
    assert captures.count() == 0 and warc.read_records(captures).count() == 0
    index = warc.write_index(captures)
    assert warc.CaptureIndex(index).captures("http://a.b/") == []
    assert warc.lookup(index, warc.page_keys(pages)).count() == 0
    assert warc.lookup(warc.write_index(warc.write_archives(pages)), warc.page_keys(pages.limit(0))).count() == 0


def test_lookup_finds_what_a_scan_finds(spark, pages, page_rows, monkeypatch):
    """Every record comes back through the index, whatever the sizes of blocks and chunks; hot keys span blocks."""
    captures = warc.write_archives(pages)
    whole = {p: [warc.parse(x) for x in warc.members(p)] for (p,) in captures.select("path").distinct().collect()}
    assert sum(map(len, whole.values())) == len(page_rows)
    for lines, chunk, bound in ((2, 1, 3), (1000, 1 << 20, 200)):
        monkeypatch.setattr(warc, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(warc, "BOUND_CHARS", bound)
        index = warc.write_index(captures, block_lines=lines)
        got = warc.read_records(warc.lookup(index, warc.page_keys(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert sorted(map(tuple, got.collect()), key=str) == want(page_rows)
        url = spark.createDataFrame([("http://example.org",), ("http://absent.org",), ("http://example.org/",), (None,)], "url string").selectExpr("url", "cast(null as long) page_id")
        found = warc.lookup(index, warc.page_keys(url), exact=False)
        keys = {warc.url_key(u) for u in ("http://example.org", "http://absent.org", None)}
        assert sorted((r.page_id for r in found.collect()), key=str) == sorted((i for i, u, _ in page_rows if warc.url_key(u) in keys), key=str)


def test_pages_that_share_an_id(spark):
    """Each row is judged by its own payload, and none is lost."""
    rows = [(5, "http://a/", "AAA"), (5, "http://b/", "UNIQUE"), (1, "http://c/", "AAA"), (7, "http://d/", "AAA"), (7, "http://d/", "BBB"), (8, "http://d/", "BBB"), (8, "http://d/", "BBB")]
    captures = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = [(r.page_id, r.payload and bytes(r.payload).decode(), r.record_type, r.refers_to) for r in warc.read_records(captures).collect()]
    assert sorted(got, key=str) == sorted([(1, "AAA", "response", None), (5, None, "revisit", 1), (5, "UNIQUE", "response", None), (7, None, "revisit", 1), (7, "BBB", "response", None), (8, None, "revisit", 7), (8, None, "revisit", 7)], key=str)


def test_url_key():
    assert warc.url_key("https://user@WWW.Example.org:8080/a/b?c=d") == "org,example,www)/a/b?c=d"
    assert warc.url_key("example.org") == "org,example)/" and warc.url_key(None) == ""
    assert warc.url_key("http://example.org?u=http://x#y") == "org,example)/?u=http://x"
    for odd in ("http://[::1/x", "http://ex\u2100mple.com/", "://", "http://", "#", "?", "a@b@c:x/", "\x00", "http://[::1]:80"):
        assert isinstance(warc.url_key(odd), str)


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(1)
    plain = ["river", "stone", "cloud", "green", "window", "paper", "garden", "music", "light", "silver"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(10, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "zorg" + rng.choice(["ish", "er", "ol", "ant", "um"]))
        rows.append((i, " ".join(w), "x"))
        if i % 3 != 1:
            labels.append((i, int(bad)))
    rows += [(None, "stone river", "x"), (1000, None, "x"), (1001, "", "x"), (1002, "zorgopia " * 3, "x"), (1003, "stone " * 20000, "x"), (5, rows[5][1], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (2, None), (None, 1), (0, 1)], "doc_id long, toxic int")


def test_toxicity(speech):
    docs, labels = speech
    got = toxicity.score_toxicity(docs, labels).withColumn("held_out", toxicity.fold(F.col("doc_id")) == 2).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == int(i % 6 == 0) for i in range(600))
    assert by[1002].predicted == 1 and not any(by[i].predicted for i in (1000, 1001, 1003))


def test_toxicity_without_labels(speech):
    docs, labels = speech
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_ratio_is_a_difference_of_distributions():
    """Over all last letters, each class's probabilities after a counted head sum to one."""
    pieces = [b"stone", b"stove", b"zorg", b"zorga"]
    gram, word, size = toxicity.grams(pieces)
    assert len(gram) == sum(len(p) + 1 for p in pieces) and size.tolist() == [6, 6, 5, 6]
    keys, which = np.unique(gram, return_inverse=True)
    counts = np.zeros((2, len(keys)))
    np.add.at(counts[0], which[word < 2], 10)
    np.add.at(counts[1], which[word >= 2], 10)
    ratio = toxicity.Ratio(keys, counts)
    per_word = np.bincount(word, weights=ratio(gram))
    assert (per_word[:2] < 0).all() and (per_word[2:] > 0).all()
    assert ratio(np.array([(1 << 40) - 1])).tolist() == [0.0]


@pytest.mark.parametrize("block", [24 << 20, 1])
def test_no_expression_is_too_rare_to_count(spark, monkeypatch, block):
    """An expression seen once among nine million places still tells, and evidence is that of all n-grams counted."""
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", block, raising=False)
    learnt = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 < 2]
    text = {learnt[0]: ("stone ", 1_500_000), learnt[1]: ("green zorgish river", 1), learnt[2]: ("green river été", 1), 1000: ("stone zorgish zorga", 2), 1001: ("日本 unheard", 1), 1002: (" ", 1)}
    docs = spark.createDataFrame([(i, *t) for i, t in text.items()], "doc_id long, t string, n int").selectExpr("doc_id", "repeat(t, n) as text").repartition(2)
    labels = spark.createDataFrame([(i, int(i == learnt[1])) for i in learnt[:3]], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got[1000].most > 3 and got[1000].mean_ratio > 0 and got[learnt[1]].mean_ratio > 0
    split = {i: (t * min(n, 2)).lower().encode().split() for i, (t, n) in text.items()}
    counts = {}
    for i in learnt[:3]:
        for g in toxicity.grams(split[i])[0].tolist():
            counts.setdefault(g, [0, 0])[int(i == learnt[1])] += text[i][1] // min(text[i][1], 2)
    ratio = toxicity.Ratio(np.array(list(counts)), np.array(list(counts.values())).T)
    for i, pieces in split.items():
        gram, word, size = toxicity.grams(pieces or [b"-"])
        own = np.bincount(word, weights=ratio(gram)) if pieces else np.zeros(1)
        want = [own.sum() / size.sum(), own.max(), np.log1p(np.maximum(own - 3, 0).sum() if text[i][1] < 3 else 0)]
        assert np.allclose([got[i].mean_ratio, got[i].most, got[i].large], want, atol=1e-5)


def test_pipeline(spark, tmp_path, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_similarity import brute_near

    docs = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows if i is not None and i != 150]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha alpha beta words that stand in no document of this corpus at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    # No labels, no items found: what goes is what the lines and the near duplicates take.
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    held = {}
    for i, t, *_ in docs:
        for x in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(x, set()).add(i)
    left = []
    for i, t, *_ in docs:
        kept = [x for x in (t or "").split("\n") if len(key(x)) < 10 or min(held[key(x)]) == i]
        if kept:
            left.append((i, "\n".join(kept)))
    assert got == {i for i, group, *_ in brute_near(left) if i == group}


@pytest.mark.parametrize("most", [-1, 32 << 20])
def test_lost_ids_beyond_the_bound_are_not_broadcast(spark, most, monkeypatch):
    """Spark would broadcast them by its guess of their file; a null id stays either way."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string").selectExpr("*", "'' AS lang", "'' AS source", "1L AS n_chars")
    left = corpus_pipeline._without(docs, spark.createDataFrame([(2,), (2,)], "doc_id long"))
    assert ("Broadcast" in left._jdf.queryExecution().executedPlan().toString()) == (most > 0)
    assert {r.doc_id for r in left.collect()} == {1, None}
