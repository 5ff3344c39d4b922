"""Exact, near and line dedup against brute force."""

import hashlib
import itertools
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash

from letterbox.llm import exact_dedup as X
from letterbox.llm import shingle_dedup as S
from letterbox.llm.components import components
from letterbox.llm.exact_dedup import exact_dedup
from letterbox.llm.line_dedup import line_dedup
from letterbox.llm.shingle_dedup import shingle_dedup
from letterbox.llm.simhash_dedup import ball, links, segments, simhash_dedup, simhash_groups

DOCS = "/root/testdata/sf0.001/documents.parquet"
LONG = " ".join(f"w{i}" for i in range(60))
HALF = " ".join(f"v{i}" for i in range(26))
EDGE = [(1, "a b c\nd\ne"), (1, "a b c\nd\ne"), (20, f"x\n{LONG}\ny"), (21, f"{LONG}\nz"), (22, f"{HALF}\n{HALF} b\n\nc"), (23, f"q\n{HALF}\n{HALF} b\n\nd"), (None, f"{HALF} b\n\nc"), (24, "l\n" * 3000 + LONG), (2, None), (3, ""), (None, "z"), (None, "z"), (4, "q"), (None, "q"), (5, "w " * 30000), (6, "w " * 30000), (7, "a b c\nd\nf")]


@pytest.fixture(scope="module", params=["table", "edge", "empty"])
def docs(request, spark):
    if request.param == "table":
        if not Path(DOCS).exists():
            pytest.skip("no tables here")
        return spark.read.parquet(DOCS)
    return spark.createDataFrame([] if request.param == "empty" else [(*r, "x", 7) for r in EDGE], "doc_id long, text string, doc string, depth int")


def key(doc_id):
    return (doc_id is not None, doc_id or 0)


def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_exact(docs):
    groups = defaultdict(list)
    for d, t in rows(docs):
        groups[t or ""].append(d)
    got = exact_dedup(docs).select("doc_id", "text", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(got) == sum(map(len, groups.values()))
    for r in got:
        own = groups[r.text or ""]
        assert (r.keep_id, r.group_size) == (max(own, key=key), len(own))
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    least = exact_dedup(docs, keep="min", fan_in=2).collect()
    assert {(r.text or "", r.keep_id) for r in least} == {(t, min([d for d in own if d is not None], default=None)) for t, own in groups.items()}


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    data = rows(docs)
    cache = {t: fingerprint(t) for t in {t for _, t in data}}
    fps = sorted(set(cache.values()))
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                up[root(a)] = root(b)
    members = defaultdict(list)
    for d, t in data:
        members[root(cache[t])].append(d)
    want = sorted(((d, cache[t], min([m for m in members[root(cache[t])] if m is not None], default=None)) for d, t in data), key=repr)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_groups(docs).collect()), key=repr)
    assert got == want
    stay = simhash_dedup(docs)
    assert stay.columns == docs.columns
    assert {r.doc_id for r in stay.collect()} == {c for _, _, c in want}


def test_runs_are_merged_as_they_are():
    rng = np.random.default_rng(5)
    made = [(bytes(rng.integers(0, 3, 32, dtype=np.uint8)) if k % 7 else bytes(32), k % 2, 0, 1, k, 1, 1) for k in range(4000)]
    runs = [np.array(sorted(made[k::4]), X._ENTRY) for k in range(4)]
    X._CHUNK, held = 50, X._CHUNK
    out = np.concatenate(list(X.merge_runs([[r[:100], r[100:]] for r in runs], "max")))
    X._CHUNK = held
    want = defaultdict(list)
    for d, size, _, _, k, _, _ in made:
        want[d.rstrip(b"\0"), size].append(k)
    assert {(bytes(e["digest"]), e["size"]): (e["id"], e["n"]) for e in out} == {k: (max(v), len(v)) for k, v in want.items()}
    assert len(out) == len(want)


def test_exact_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a", 1)] * 500 + [(7, "b", 2)] * 300 + [(6, "b", 3)], "doc_id long, text string, n int").repartition(5)
    got = exact_dedup(docs).groupBy("text").agg({"kept": "max", "doc_id": "max"})
    assert exact_dedup(docs).filter("kept").count() == got.count() == 2
    assert {(r.text, r.doc_id) for r in exact_dedup(docs).filter("kept").collect()} == {("a", None), ("b", 7)}


@pytest.mark.parametrize(("entries", "hot"), [(0, 1024), (10**10, 1024), (0, 3)])
def test_links_by_every_cut(spark, entries, hot):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    fps = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for x in seeds for _ in range(12)}
    want = {(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 4}
    signed = spark.createDataFrame([(x - (1 << 64) * (x >> 63),) for x in fps], "fp long")
    got = {(r.a % 2**64, r.b % 2**64) for r in links(signed, 4, entries, hot).collect()}
    assert got | {(b, a) for a, b in got} == want


def test_segments_find_every_pair():
    assert [w for _, w, _ in segments(4)] == [13, 13, 13, 13, 12] and [w for _, w, _ in segments(4, 10**6)] == [22, 21, 21] and [w for _, w, _ in segments(4, 10**9)] == [32, 32]
    for bits, n in ((1, 0), (2, 10**9), (3, 10**5), (4, 10**6), (4, 10**9), (6, 10**7)):
        cuts = segments(bits, n)
        assert sum(w for _, w, _ in cuts) == 64 and sum(r + 1 for _, _, r in cuts) == bits + 1
    assert len(ball(22, 1)) == 23 and len(set(ball(5, 2))) == 16


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_components(data):
    """(doc_id, text) that stay, by comparing all pairs of texts."""
    sets = {t or "": shingle_set(t) for _, t in data}
    texts, up = list(sets), {t: t for t in sets}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    least = {}
    for d, t in data:
        least[root(t or "")] = min(least.get(root(t or ""), (True, 0)), (d is None, d or 0))
    return {(d, t) for d, t in data if (d is None, d or 0) == least[root(t or "")]}


def test_shingles(docs):
    stay = shingle_dedup(docs)
    assert stay.columns == docs.columns
    got = {(r.doc_id, r.text) for r in stay.select("doc_id", "text").collect()}
    want = first_of_components(rows(docs))
    assert {d for d, _ in got} == {d for d, _ in want} and got <= want


def test_near_stage_finds_copies_at_four_fifths(spark):
    import corpus_pipeline as P

    base = [f"w{i}" for i in range(100)]
    chain = [" ".join(f"x{j}" if i in (10 * j + 5, 95) else w for i, w in enumerate(base)) for j in range(3)]
    texts = [" ".join(base), *chain, " ".join(base[:81]), " ".join(base[:80] + ["z"] * 20), " ".join(f"v{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60)) + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in P.near(spark, docs, "").collect()} == first_of_components(list(enumerate(texts)))


def family(members, most, seed):
    """Texts of 150 words that differ from one in up to ``most`` places, where a word is left out or replaced."""
    rng, out = random.Random(seed), []
    for _ in range(members):
        text = [f"w{i}" for i in range(150)]
        for i in sorted(rng.sample(range(150), rng.randint(0, most)), reverse=True):
            text[i : i + 1] = [] if rng.random() < 0.3 else [f"x{rng.randrange(40)}"]
        out.append(" ".join(text))
    return out


def test_near_stage_checks_groups_of_fingerprints_first(spark, monkeypatch):
    import corpus_pipeline as P

    asked, tried, groups, alike = [], [], S.simhash_groups, S._alike
    monkeypatch.setattr(S, "simhash_groups", lambda docs, words, bits: asked.append((words, bits)) or groups(docs, words, bits))
    monkeypatch.setattr(S, "_alike", lambda pairs, *rest: tried.append(pairs.count()) or alike(pairs, *rest))
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words[:k]) for k in (2000, 1999, 1998, 1997)] + [" ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in P.near(spark, docs, "").collect()} == {0, 4}
    assert asked == [(5, 4)] and tried[0] == 3 and sum(tried[1:]) <= 3


@pytest.mark.parametrize(("crowd", "turns"), [(256, 4), (3, 0)])
def test_outliers_of_a_large_group(spark, monkeypatch, crowd, turns):
    tried, alike = [], S._alike
    monkeypatch.setattr(S, "_alike", lambda pairs, *rest: tried.append(pairs.count()) or alike(pairs, *rest))
    monkeypatch.setattr(S, "CROWD", crowd, raising=False)
    monkeypatch.setattr(S, "TURNS", turns)
    data = list(enumerate(family(600, 10, 1) + family(20, 60, 2) + [None, "", "w0 w1"]))
    got = {(r.doc_id, r.text) for r in shingle_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == first_of_components(data)
    assert len(got) > 150  # many are not alike
    assert sum(tried) < 12000  # of some 190000 pairs


def test_differences_meet_in_their_prefixes():
    rng = np.random.default_rng(3)
    none = np.zeros(0, np.int64)
    for percent in (50, 80, 95):
        base = np.arange(1, 101)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 101), replace=False), rng.integers(200, 260, rng.integers(0, 30))])) for _ in range(120)]
        sets += [np.setdiff1d(s, rng.choice(s, 3)) for s in sets] + [none]
        pivot = sets[0]
        made = [S.differences(s, pivot, percent, np.array([203, 230]), np.array([5, 3])) for s in sets]
        for (x, (u, _, far)), (y, (v, _, off)) in itertools.combinations(zip(sets, made, strict=True), 2):
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both) and (far or off):
                assert len(np.intersect1d(u, v)) or not len(x) + len(y)
        for x, (_, a, far) in zip(sets, made, strict=True):
            both = len(np.intersect1d(x, pivot))
            assert a == len(x) + len(pivot) - 2 * both and far == (100 * both < percent * (len(x) + len(pivot) - both))


@pytest.mark.parametrize("words", [1, 4, 50])
def test_lines(docs, words):
    data = sorted({(key(d), xxhash.xxh64_intdigest((t or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63), d, t) for d, t in rows(docs)}, key=lambda x: x[:2])
    seen, gone = set(), defaultdict(set)
    for _, _, d, t in data:  # every run of lines with enough words that starts earlier too
        lines = (t or "").split("\n")
        for a in range(len(lines)):
            n, fresh = 0, 0
            for b in range(a, len(lines)):
                n += len(lines[b].split())
                run = tuple(lines[a : b + 1])
                if n >= words:
                    if run in seen:
                        gone[d, t].update(range(a, b + 1))
                    seen.add(run)
                    fresh += 1
                    if fresh > 12:  # longer runs are covered by runs that begin and end between
                        break
    want = {}
    for _, _, d, t in data:
        lines, out = (t or "").split("\n"), gone[d, t]
        runs = [len(list(g)) for k, g in itertools.groupby(range(len(lines)), lambda i: i in out) if k]
        want[d, t] = (len(lines), len(out), max(runs, default=0), "\n".join(x for i, x in enumerate(lines) if i not in out))
    out = line_dedup(docs.withColumn("was", docs["text"]), words).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_lines, r.n_removed, r.longest_run, r.text or "") == want[r.doc_id, r.was]


def test_no_pandas_in_line_dedup(spark):
    plan = line_dedup(spark.createDataFrame(pd.DataFrame({"doc_id": [1], "text": ["a\nb"]})))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
