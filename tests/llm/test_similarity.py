"""Line dedup, near duplicates, fingerprints, decontamination and licences against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tonearc.llm import common, decontamination, fingerprints, license_scan, line_dedup, ngram_join

TABLE = bytes(c + 32 if 65 <= c <= 90 else c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))


def words(text):
    return (text or "").encode().translate(TABLE).split()


def brute_lines(rows):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add((i is not None, i or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == (i is not None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(docs, rows):
    got = line_dedup.digest(line_dedup.dedup_lines(docs)).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_line_dedup_without_broadcast(docs, rows, monkeypatch):
    plain = line_dedup.suspects
    monkeypatch.setattr(line_dedup, "suspects", lambda keys: plain(keys, broadcast_bytes=-1))
    got = line_dedup.digest(line_dedup.dedup_lines(docs)).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_line_dedup_of_many_segments_and_lines(spark, monkeypatch):
    """Small segments, and a document of many lines of which many go."""
    monkeypatch.setattr(line_dedup, "SEGMENT_KEYS", 50)
    many = [f"line number {k} of a long text" for k in range(4000)]
    rows = [(1, "\n".join(many)), (2, "\n".join(many[::2] + [f"another line {k}" for k in range(500)])), (3, "\n".join([many[0]] * 300)), (4, None), (5, "Line Number 7 of a LONG text \r")]
    got = line_dedup.digest(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_bloom_knows_all_it_was_given():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    for keys in (5000, 1_000_000):
        bloom = line_dedup.Bloom(keys)
        bloom.add(a)
        bloom.fold()
        assert bloom.has(a).all() and bloom.has(b).mean() < 0.02 and len(bloom.bits) <= 1 << 14
        again = line_dedup.Bloom(0, bloom.bits)
        assert again.has(a).all()


def grams(text, n=3):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_near(rows, t=0.6):
    named = [(i, x) for i, x in rows if i is not None]
    least = {}
    for i, x in named:
        g = grams(x)
        least[g] = min(i, least.get(g, i))
    reps = {v: k for k, v in least.items()}
    parent, degree = {i: i for i in reps}, defaultdict(int)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in reps:
        for b in reps:
            if a < b and reps[a] and reps[b] and len(reps[a] & reps[b]) / len(reps[a] | reps[b]) >= t:
                degree[a] += 1
                degree[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, find(least[grams(x)]), least[grams(x)], degree[least[grams(x)]]) for i, x in named)


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicates(docs, rows, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = ngram_join.near_duplicates(docs)
    named = sorted((r.doc_id, r.group_id, r.copy_of, r.n_links) for r in got.collect() if r.doc_id is not None)
    assert named == brute_near(rows)
    assert got.where("doc_id is null").count() == 1


def brute_pairs(text):
    least = {}
    for i in sorted(text):
        least.setdefault(grams(text[i]), i)
    sets = {i: s for s, i in least.items()}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("kind", ["mixed", "near"])
def test_forest_recall(spark, kind, monkeypatch):
    """Edited copies of many kinds, and a cluster whose members are all alike: recall against brute force; where all
    links are near, prefixes stay longer."""
    rng = np.random.default_rng(8)
    text, used = {}, []
    for k in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for c in range(5):
            own = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 15 if kind == "mixed" else 2)):
                own[at] = f"v{rng.integers(0, 5000)}"
            text[1000 * k + c] = " ".join(own)
    plain = ngram_join.shortened
    monkeypatch.setattr(ngram_join, "shortened", lambda *a: used.append(plain(*a)) or used[-1])
    monkeypatch.setattr(ngram_join, "PROBE", 2)
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    got = {(r.a, r.b): r.jaccard for r in ngram_join.similar_pairs(docs).collect()}
    want = brute_pairs(text)
    print("recall", len(got) / len(want), "of", len(want), "depth", used)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and all(abs(want[p] - x) < 1e-12 for p, x in got.items())
    assert used == ([4] if kind == "mixed" else [max(used)]) and (kind == "mixed" or used[0] > 4)
    links = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs).collect()}
    first = {}
    for i in sorted(text):
        first.setdefault(grams(text[i]), i)
    reps = set(first.values())
    assert sum(links[i] for i in reps) == 2 * len([p for p in got if set(p) <= reps])


def test_a_large_cluster_stays_linear(spark):
    """What is shuffled for a cluster of near copies of each other grows by the blocks, not by the pairs."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 9000, 60)]
    text = {}
    for i in range(2500):
        own = list(base)
        own[int(rng.integers(0, 60))] = f"x{i}"
        text[i] = " ".join(own)
    got = ngram_join.near_duplicates(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()
    assert {r.group_id for r in got} == {0} and all(r.n_group == 2500 for r in got)
    sets = [grams(text[i]) for i in range(2500)]
    for i in range(0, 2500, 500):
        assert abs(got[[r.doc_id for r in got].index(i)].n_links - sum(len(sets[i] & s) >= 0.6 * len(sets[i] | s) for j, s in enumerate(sets) if j != i)) <= 5


def test_rows_that_share_an_id(spark):
    """Each belongs to the group of its own text."""
    a, b = "one two three four five six seven", "quite another text of some words here"
    rows = [(5, a), (5, b), (7, a + " eight"), (9, b), (3, "alone in this corpus stands this one"), (3, "alone in this corpus stands this one")]
    got = sorted((r.doc_id, r.group_id, r.copy_of, r.n_links, r.n_group) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, 3, 0, 2), (3, 3, 3, 0, 2), (5, 5, 5, 0, 4), (5, 5, 5, 1, 4), (7, 5, 7, 1, 4), (9, 5, 5, 0, 4)]


def test_depth():
    assert ngram_join.depth(0.6, 40, 0.99) == 4
    assert 1 - (1 - 0.6**4) ** 40 >= 0.99
    assert ngram_join.shortened({}, 40, 4, 0.99) == 4 and ngram_join.shortened({62: 9, 95: 100}, 40, 4, 0.99) == 4
    assert ngram_join.shortened({95: 100}, 40, 4, 0.99) == 8 and ngram_join.shortened({83: 100}, 40, 4, 0.99) > 5


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 109)]
    got = {r.doc_id: r.component for r in ngram_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 109: 100}


def test_no_side_is_broadcast_by_guess(docs, rows, monkeypatch):
    """Spark guesses a side by its compressed files and without the copies of a salt; only counted sides are broadcast."""
    plans, plain = [], common.saved
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(common, "saved", lambda df, *a, **k: plans.append(plan(df)) or plain(df, *a, **k))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    got = ngram_join.near_duplicates(docs)
    assert len(plans) > 10 and not [p for p in [*plans, plan(got)] if "Broadcast" in p]
    assert sorted((r.doc_id, r.group_id, r.copy_of, r.n_links) for r in got.collect() if r.doc_id is not None) == brute_near(rows)


def test_few_enough():
    """Counted as hash tables are: a million and more of bare ids (96 MB and up) are not few."""
    assert common.few_enough(250_000, 24) and not common.few_enough(1_000_000, 24) and not common.few_enough(400_000, 56)


def test_fingerprints(docs, rows, monkeypatch):
    got = fingerprints.fingerprints(docs).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    prints = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        r = next(x for x in by[i] if x.edited_sha256 == sha)
        assert r.n_chars == len(t)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1
        if after == t:
            assert r.near_next == 1
    assert len(set(prints.values())) == len(prints)


def test_equal_substrings_share_names():
    rng = np.random.default_rng(2)
    core = rng.integers(97, 123, 4000).astype(np.uint32)

    def phrases(before):
        x = np.concatenate([rng.integers(97, 123, before).astype(np.uint32), core])
        names, first = fingerprints.parse(fingerprints._mix(x.astype(np.uint64)), np.array([0, len(x)]))
        return names, set(fingerprints.parse(names, first)[0].tolist())

    (_, one), (_, two) = phrases(13), phrases(700)
    assert len(one & two) > 0.97 * len(one)


def test_rows_do_not_touch():
    rng = np.random.default_rng(4)
    text = ["".join(chr(c) for c in rng.integers(97, 101, n)) for n in (1, 2, 3, 50, 0, 700, 5, 80, 400)]
    together = fingerprints.sketches(*fingerprints._points(text))
    for t, s in zip(text, together):
        assert [x.tolist() for x in fingerprints.sketches(*fingerprints._points([t]))[0]] == [x.tolist() for x in s]


def test_fingerprint_likeness_follows_edits():
    rng = np.random.default_rng(5)
    text = "".join(chr(c) for c in rng.integers(97, 123, 20000))
    other = "".join(chr(c) for c in rng.integers(97, 123, 20000))
    s = fingerprints.sketches(*fingerprints._points([text, text[:19000] + other[:1000], text[:10000] + other[:10000], other]))
    near = [fingerprints.likeness(s[0], x) for x in s]
    assert near[0] == 1 and near[1] > 0.75 and 0.15 < near[2] < 0.55 and near[3] < 0.1


def test_fingerprint_likeness_has_no_step():
    """A letter more changes little at every length, and unrelated texts stay apart; means over many texts by length."""
    from tests.llm.conftest import prose
    import random

    rng = random.Random(3)
    before = 0.0
    for n in (*range(20, 120, 6), 160, 300, 600):
        text = [prose(rng, 200)[k : k + n] for k in range(30)]
        s = fingerprints.sketches(*fingerprints._points([x for t in text for x in (t, t + "q", t[: n - n // 4] + "zyxw" * (n // 16))]))
        like = lambda k: np.mean([fingerprints.likeness(s[3 * i], s[3 * i + k]) for i in range(30)])
        assert like(1) > 0.4 and like(1) > before - 0.12 and like(1) > like(2) > 0.2
        before = like(1)
        assert fingerprints.compare(fingerprints.show(s[0]), fingerprints.show(s[1])) == fingerprints.likeness(s[0], s[1])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [
            (1, "If Alice buys 12 apples for 30 dollars, how much does Alice pay for 40 apples at the same price per apple today"),
            (2, "the quick brown fox jumps over the lazy dog while seven silver lamps light up a quiet garden"),
            (3, None), (4, ""), (5, "9 8 7"), (None, "an item without an id but with many words in it anyhow"),
        ],
        "item_id long, text string",
    )


def test_decontamination(spark, items):
    text = {
        1: "Intro words. if Alice buys 12 apples for 30 dollars, how much does Alice pay for 40 apples at the same price per apple today? End.",
        2: "Well. if Bob buys 7 apples for 55 dollars, how much does Bob pay for 90 apples at the same price per apple today? So.",
        3: "Well. if Bob buys 7 apples for 55 dollars, how much does Carol pay for 7 apples at the same price per apple today? So.",
        4: "nothing of the kind stands here, only ordinary words in a row that goes on and on",
        5: "x the quick brown fox jumps over the lazy dog while seven silver lamps light up a quiet garden y",
        6: None, 7: "",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in text.items()] + [(None, text[1], "x")], "doc_id long, text string, hash string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 2)}
    assert got[1, 1].exact and not got[2, 1].exact and got[2, 1].consistency == 1
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_judges_each_placement(spark):
    """Items that match themselves crosswise, and documents with an item and its variant."""
    cakes = "On Monday he sold {} cakes, on Tuesday he sold {} cakes, on Wednesday he sold {} cakes, how many cakes did he sell in all of these days"
    apples = "If {} buys {} apples for {} dollars, how much does {} pay for {} apples at the same price per apple today"
    one, other = apples.format("Alice", 12, 30, "Alice", 40), apples.format("Bob", 7, 55, "Bob", 90)
    items = spark.createDataFrame([(1, cakes.format(5, 7, 9)), (2, one)], "item_id long, text string")
    text = {1: "So. " + cakes.format(5, 7, 9) + ". End.", 2: f"So. {one}? Then. {other}? End.", 3: apples.format("Bob", 7, 55, "Carol", 7)}
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(spark.createDataFrame(list(text.items()), "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 1), (2, 2)} and got[1, 1].exact and got[2, 2].exact and got[2, 2].coverage == 1


def test_decontamination_finds_items_without_literal_windows(spark):
    """Arithmetic and name tables stand verbatim in documents, whatever stands around them."""
    items = spark.createDataFrame([(1, "12 + 7 - 3 = 16"), (2, "Ann Lee 4, Bob Ray 5, Carl Orr 6, Dora Poe 7, Emil Fox 8"), (3, "9 8 7")], "item_id long, text string")
    text = {1: "so 5 12 + 7 - 3 = 16 44 and", 2: "Names: ann lee 4, Bob Ray 5, Carl Orr 6, Dora Poe 7, Emil Fox 8.", 3: "count 10 9 8 7 6", 4: "7 8 9 and 12 + 7 - 4 = 15, Ann Lee 5", 5: ""}
    got = decontamination.contaminated(spark.createDataFrame(list(text.items()), "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.exact, r.coverage) for r in got) == [(1, 1, True, 1.0), (2, 2, True, 1.0), (3, 3, True, 1.0)]


def brute_template(text):
    """(token, value or None) of each template token."""
    raw, out, end = text.encode(), [], 0
    found = []
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw):
        word = m.group().decode()
        start = not found or any(c in raw[end : m.start()] for c in b".!?:\n")
        end = m.end()
        kind = "number" if word[0] in "0123456789" else "name" if word[0].isupper() and not start else "word"
        found.append([kind, word.lower()])
    for k in range(1, len(found)):
        if found[k][0] == "word" and found[k - 1][0] == "number" and found[k][1].encode() in decontamination.UNITS:
            found[k][0] = "unit"
    for kind, low in found:
        if kind == "word":
            out.append((low, None))
        elif out and out[-1][0] == (kind,):
            out[-1] = ((kind,), (*out[-1][1], low))
        else:
            out.append(((kind,), (low,)))
    return out


def brute_contaminated(docs, items, window=8):
    found = set()
    for item, text in items:
        own = brute_template(text or "")
        n = min(window, len(own))
        plain = [(w, None) for w in words(text)]
        good = [k for k in range(len(own) - n + 1) if n and sum(v is None for _, v in own[k : k + n]) >= 0.5 * n]
        modes = [(False, own, n, good)]
        if n and len(good) < len(own) - n + 1 and plain:
            m = min(window, len(plain))
            modes.append((True, plain, m, list(range(len(plain) - m + 1))))
        for doc, body in docs:
            for verbatim, mine, m, places in modes:
                theirs = [(w, None) for w in words(body)] if verbatim else brute_template(body or "")
                at = defaultdict(list)
                for k in range(len(theirs) - m + 1):
                    at[tuple(w for w, _ in theirs[k : k + m])].append(k)
                hits = [(d, k) for k in places for d in at.get(tuple(w for w, _ in mine[k : k + m]), ())]
                diagonals, runs = sorted({d - k for d, k in hits}), {}
                for q, x in enumerate(diagonals):
                    runs[x] = runs[diagonals[q - 1]] + (x - diagonals[q - 1] > 3) if q else 0
                parts = defaultdict(list)
                for d, k in hits:
                    for part in ("all", ("run", runs[d - k]), ("at", d - k)):
                        parts[part].append((d, k))
                for some in parts.values():
                    pairs = {(a, b) for d, k in some for (_, a), (_, b) in zip(mine[k : k + m], theirs[d : d + m]) if a is not None}
                    fit = min(len({a for a, _ in pairs}), len({b for _, b in pairs})) / len(pairs) if pairs else 1
                    if len({k for _, k in some}) >= 0.3 * len(places) and fit >= 0.9:
                        found.add((doc, item, all(a == b for a, b in pairs)))
    return {(d, i, max(e for x, y, e in found if (x, y) == (d, i))) for d, i, _ in found}


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_by_brute_force(spark, broadcast, monkeypatch):
    """Random texts with items, variants of items with and without consistent slots, and cut ones; long texts, ties and
    repeated rows; by broadcast, and with a crowded Bloom filter and shuffled windows."""
    import random

    if not broadcast:
        monkeypatch.setattr(decontamination, "FILTER_WINDOWS", 0)
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(decontamination, "HOT_SHARE", 0.02)
    rng = random.Random(6)
    vocabulary = ["red", "house", "runs", "over", "the", "of", "small", "tree", "when", "blue", "sum", "cost"]
    names, units = ["Ann", "Bob", "Émile", "Dora"], ["km", "kg", "dollars"]

    def sentence(n, swap=None):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(rng.choice(vocabulary) if x < 0.7 else str(rng.randint(1, 9)) if x < 0.85 else f"{rng.randint(1, 9)} {rng.choice(units)}" if x < 0.92 else rng.choice(names))
        return " ".join(out)

    items = [(k, sentence(rng.randint(1, 30))) for k in range(12)] + [(20, None), (21, ""), (22, "5 6 7 8 9 1 2 3 4 5"), (23, "red house")]
    docs = []
    for k in range(40):
        body = rng.choice(items[:12])[1]
        how = k % 5
        if how == 1:  # every value another, the same for the same
            new = {x: y for x, y in zip(names, [*names[1:], names[0]])} | {str(d): str(d % 9 + 1) for d in range(1, 10)}
            body = " ".join(new.get(w, w) for w in body.split())
        elif how == 2:
            body = " ".join(str(rng.randint(1, 9)) if w.isdigit() else w for w in body.split())
        elif how == 3:
            body = " ".join(body.split()[: len(body.split()) // 2])
        elif how == 4:
            body = sentence(30)
        docs.append((k, f"{sentence(6)}, {body} {sentence(6)}."))
    docs += [(50, docs[0][1] + " " + docs[1][1]), (51, sentence(4000) + " " + items[0][1]), (52, items[22 - 20 + 12][1]), (53, None), (54, "")]
    rows = [*docs, docs[0], docs[3]]
    clash = ["hash", "at", "name", "slots", "item_id", "verbatim"]
    source = spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    got = {(r.doc_id, r.item_id, r.exact) for r in decontamination.contaminated(source, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_contaminated(docs, items)
    assert got == want and len(want) > 15 and 0 < sum(e for *_, e in want) < len(want)


def test_template_tokens():
    import pyarrow as pa

    token, kind, _, first = decontamination.template(*common.text_bytes(pa.array(["We met Ann Lee at 5 km. Then", "", "3.5 x"])))
    assert kind.tolist() == [0, 0, 2, 0, 1, 3, 0, 1, 0] and first.tolist() == [0, 7, 7, 9]
    assert len(token) == 9


def test_license_scan(spark):
    text = {
        1: "Released under the MIT License. More text follows.", 2: "Licensed under the Apache License, Version 2.0. And CC BY-NC 4.0 under the mit license under the MIT license",
        3: "This work is licensed under the GNU General Public License, version 3.", 4: "no terms at all", 5: None, 6: "",
        7: "Permission is hereby granted free of charge to any person who is obtaining a copy of this software and its associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in text.items()] + [(None, text[1], "x")], "doc_id long, text string, template string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert set(got) == {*text, None}
    for i, t in text.items():
        w = [x.decode() for x in words(t)]
        places = {k: label for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(set(places.values())))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[3].labels == "gpl-3" and got[3].score == 1 and got[4].score == 0 and got[4].labels == ""
    assert got[7].labels == "mit" and 0.8 <= got[7].score < 1
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_scan_judges_rows_by_their_texts(spark):
    """Null ids, ids of several texts, copies, long texts and clashing columns."""
    gpl, plain = "This work is licensed under the GNU General Public License, version 3.", "nothing here at all"
    rows = [(None, gpl), (None, plain), (5, gpl), (5, plain), (7, gpl), (7, gpl), (8, "word " * 60000 + gpl + " word" * 60000), (9, gpl + " " + gpl)]
    docs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, text string, key string, runs string, spans string")
    got = sorted(((r.doc_id, r.labels, r.score, r.n_words) for r in license_scan.scan(docs).collect()), key=str)
    assert got == sorted(((i, "gpl-3" if "GNU" in t else "", 1.0 if "GNU" in t else 0.0, len(words(t))) for i, t in rows), key=str)


def test_license_excerpts_in_prose(spark):
    """A verbatim excerpt of 26 words of a template inside prose that shares its common words is found, with its place;
    20 words of it are the least, scattered words are none, and a text of repeated phrases stays cheap."""
    template = license_scan.TEMPLATES["mit"][1].split()
    prose = "the people of the town and the owner of the house went to the sea without any of the copies and to the shop of this or the other".split()
    text = {
        1: " ".join([*prose, *template[10:36], *prose]), 2: " ".join([*prose, *template[10:20], *prose]), 3: " ".join(prose * 3),
        4: " ".join(template[::3]), 5: " ".join(template[10:36] * 400), 6: license_scan.TEMPLATES["mit"][3],
    }
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.labels == "mit"} == {1, 5, 6} and all(got[i].labels == "" for i in (2, 3, 4))
    span = got[1].spans[0]
    n = len(words(" ".join(prose)))
    assert n - 2 <= span.first <= n + 1 and abs(span.last - (n + len(words(" ".join(template[10:36]))) - 1)) <= 2


def test_longest_common_subsequence():
    """Against plain dynamic programming."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(1, 12))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        at = license_scan._common(a, b)
        assert len(at) == best[-1, -1] and at == sorted(set(at))
        k = 0
        for x in b:
            k += k < len(at) and a[at[k]] == x
        assert k == len(at)


def test_empty(none):
    assert line_dedup.dedup_lines(none).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0
    assert fingerprints.fingerprints(none).count() == 0


def test_words(rows):
    import pyarrow as pa

    column = pa.array([t or "" for _, t in rows])
    low, starts, ends, first = common.words(*common.text_bytes(column))
    for k, (_, t) in enumerate(rows):
        own = [low[a:z].tobytes() for a, z in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])]
        assert own == words(t)
        lower = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        assert len(own) == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower))
