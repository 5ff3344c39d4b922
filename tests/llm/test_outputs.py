"""Tokens, packing, mixing, archives and the pipeline: exact round trips and brute force."""

import hashlib
import random
import re
import struct
import zlib
from array import array
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from letterbox.llm import _tokens, packing, warc
from letterbox.llm._common import WORD, cut
from letterbox.llm._tokens import encoder
from letterbox.llm._wavelet import WaveletMatrix
from letterbox.llm.exact_dedup import exact_dedup
from letterbox.llm.langid import fit, identify
from letterbox.llm.line_dedup import line_dedup
from letterbox.llm.mixing import apply_mix, mix
from letterbox.llm.packing import best_fit_pack, pieces, plan
from letterbox.llm.quality import BARS, ENDS, SHORT, SIGNS, furniture, quality, quality_filter
from letterbox.llm.queries import vocabulary
from letterbox.llm.secrets import scan_secrets
from letterbox.llm.shingle_dedup import shingle_dedup
from letterbox.llm.simhash_dedup import simhash_dedup, simhash_groups
from letterbox.llm.token_files import read_token_files, write_token_files
from tests.llm.test_dedup import first_of_components

DOCS = "/root/testdata/sf0.001/documents.parquet"
EDGE = [(1, "a", "A"), (1, "a", "A"), (2, None, None), (None, "zz top", "B"), (3, "w " * 9000, "B"), (4, "", "A")]


@pytest.fixture(scope="module", params=["table", "edge", "empty"])
def docs(request, spark):
    if request.param == "table":
        if not Path(DOCS).exists():
            pytest.skip("no tables here")
        return spark.read.parquet(DOCS)
    return spark.createDataFrame([] if request.param == "empty" else EDGE, "doc_id long, text string, source string")


def ids_of(text):
    return encoder(vocabulary()).whole.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def test_encoder_is_exact():
    words, rng = encoder(vocabulary()), random.Random(1)
    texts = ["It's DON'T we'll", "***'s ²³ ½ ªº µ", "Σ ΑΣ İstanbul ſ K", "é å", "<|endoftext|> a<|endoftext|>b", "日本語 text", "a\x1cb\x85c\x0bd", "😀👍🏽", "", " \n", "ÀÉ ẞ ß Ÿ", "x" * 5000, "a.b, c., d.' e", "1,000.5"]
    texts += ["".join(rng.choice("abcÉé'sS1²½×#$%&<|>.,, \n\t́Σß😀") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for text, got in zip(texts, words.encode_all(texts), strict=True):
        assert got == array("I", words.whole.encode(text, add_special_tokens=False).ids).tobytes(), text


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no tables here")
def test_encoder_on_all_texts():
    column = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].combine_chunks()
    words = encoder(vocabulary())
    want = words.whole.encode_batch([x or "" for x in column.to_pylist()], add_special_tokens=False)
    assert all(array("I", w.ids).tobytes() == got for w, got in zip(want, words.encode_column(column), strict=True))


def test_encoder_in_parts(monkeypatch):
    monkeypatch.setattr(_tokens, "SLICE", 40)
    monkeypatch.setattr(_tokens, "CACHE", 200)
    monkeypatch.setattr(_tokens, "BLOCK", 30)
    words, rng = _tokens.Encoder(vocabulary()), random.Random(2)
    texts = ["".join(rng.choice("abcÉé'sS1²½×#.,, \n\t́Σß😀 tremvdl0") for _ in range(rng.randint(0, 300))) for _ in range(600)] + ["x" * 500, "'s 're'll''s don't I'm"]
    column = pa.array([*texts, None], pa.string())
    got = list(words.encode_column(column.slice(7)))
    assert got == [array("I", words.whole.encode(x, add_special_tokens=False).ids).tobytes() for x in texts[7:]] + [b""]


def test_wavelet():
    ids = np.random.default_rng(1).integers(0, 300, 3000).astype("<u4")
    matrix, arrays = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes({"a": np.arange(3)}))
    assert (matrix.decode() == ids).all() and arrays["a"].tolist() == [0, 1, 2]
    assert all(matrix.access(i) == ids[i] for i in range(0, 3000, 37))
    for token in (0, 7, 299, 4000):
        assert matrix.occurrences(token) == np.flatnonzero(ids == token).tolist()
        assert matrix.rank(token, 1234) == (ids[:1234] == token).sum()
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes()[:-9])


def test_token_files(docs):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    got = read_token_files(write_token_files(docs, vocabulary(), shard=5000)).collect()
    got = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [x[:2] for x in rows]
    at, want = 0, defaultdict(list)
    for _, d, text in rows:
        want[d].append(crc([*ids_of(text), 2]))
    for r in got:
        assert r.start == at and r.ids_crc32 in want[r.doc_id or 0]
        at += r.n_tokens


def test_plan():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 65), 40)}
    entries = plan(counts, 64)
    used = defaultdict(list)
    for length, rank, n, first, each, offset in entries:
        for k in range(n):
            used[first + k // each].append((offset + k % each * length, length))
    assert sum(map(len, used.values())) == sum(counts.values())
    for items in used.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:], strict=False)) and sum(n for _, n in items) <= 64
    bins: list[int] = []  # best fit decreasing, a piece at a time
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            k = min((k for k, free in enumerate(bins) if free >= length), key=lambda k: bins[k], default=None)
            if k is None:
                bins.append(64 - length)
            else:
                bins[k] -= length
    assert len(used) == len(bins)
    assert len(used) >= max(-(-sum(k * v for k, v in counts.items()) // 64), sum(v for k, v in counts.items() if k > 32))


def test_packing(docs):
    want = sorted((r.doc_id or -1, i, i * 4096, len(c), crc(c)) for r in docs.collect() for ids in [[*ids_of(r.text), 1]] for i, c in enumerate([ids[k : k + 4096] for k in range(0, len(ids), 4096)]))
    got = best_fit_pack(docs, vocabulary()).collect()
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(x[3] for x in want) // 4096) + 1


def test_mix(docs):
    got = mix(docs).collect()
    assert len(got) == docs.count()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while names:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = {s for s in rest if share[s] > 3 * sizes[s]}
        if not above:
            break
        full |= above
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        target = 3 * sizes[r.source] if r.source in full else share[r.source]
        assert r.target == pytest.approx(target) and r.source_size == sizes[r.source]
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in names:
        target = 3 * sizes[s] if s in full else share[s]
        assert abs(taken[s] - target) <= most[s]
    again = mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert apply_mix(docs).count() == sum(r.copies for r in got)
    assert apply_mix(docs).columns == docs.columns


def test_warc_table(spark):
    rows = [(1, "u\r\nx", None), (None, None, "z" * 2000), (None, "a", "z" * 2000), (5, "b", "z" * 2000), (5, "b", "z" * 2000), (6, "c", "y" * 999), (7, "c", "y" * 999), (8, "d", "ñ" * 300000)]
    if Path("/root/testdata/sf0.001/pages.parquet").exists():
        rows += [(r.page_id + 100, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] + [(3, "copy", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(warc.deduplicate(pages))).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[hashlib.sha1((h or "").encode()).hexdigest()].append((p, len((h or "").encode())))
    kinds = defaultdict(list)
    for r in got:
        own = groups[r.payload_digest]
        assert (r.page_id, r.payload_bytes) in own
        kinds[r.payload_digest].append((r.record_type, r.refers_to))
        assert r.record_type == "revisit" or hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    for digest, own in groups.items():
        n_full = 1 if own[0][1] >= 1000 else len(own)
        assert [k for k, _ in kinds[digest]].count("response") == n_full
        assert {x for k, x in kinds[digest] if k == "revisit"} <= {max(p or -1 for p, _ in own)}
    assert warc.read_archives(warc.write_archives(warc.deduplicate(pages.limit(0)))).count() == 0


def test_warc_bytes():
    records = [warc.record(i, "https://a.org", f"<p>{i}</p>".encode() * 50, "response", None, str(i)) for i in range(40)]
    data = warc.pack(records, warc.dictionary(records))
    assert struct.unpack_from("<I", data)[0] == warc.SKIPPABLE
    assert list(warc.unpack(data)) == records
    words = warc.dictionary(records)
    packed = zstandard.ZstdCompressor().compress(words)
    plain = warc.pack(records, words)
    nested = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + plain[8 + len(words) :]
    assert list(warc.unpack(nested)) == records
    again = warc.parse(warc.record(3, "u", b"x" * 2000, "revisit", 9, "n"))["fields"]
    assert again["warc-refers-to"] == warc.parse(warc.record(9, "u", b"x" * 2000, "response", None, "m"))["fields"]["warc-record-id"]
    with pytest.raises(ValueError):
        list(warc.unpack(data[:-3]))
    for bad in (records[0][:-1], records[0].replace(b"<p>0", b"<p>1", 1), records[0].replace(b"WARC-Date", b"WARC-Dote"), b"x"):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_damaged_archives(spark, tmp_path):
    good = [warc.record(i, None, b"<p>%d</p>" % i, "response", None, str(i)) for i in range(4)]
    (tmp_path / "a").write_bytes(warc.pack([good[0], good[1][:-9] + b"x", good[2]], b""))
    (tmp_path / "b").write_bytes(warc.pack(good[:2], b"")[:-3])
    (tmp_path / "c").write_bytes(b"no archive")
    files = spark.createDataFrame([(f"file://{tmp_path}/{x}",) for x in "abc"], "path string")
    got = sorted((r.record_type, r.page_id, r.error is None) for r in warc.read_archives(files).collect() if r.record_type != "damaged")
    assert got == [("response", 0, True), ("response", 0, True), ("response", 2, True)]
    assert warc.read_archives(files).filter("record_type = 'damaged' AND error IS NOT NULL").count() == 3


CLASHES = "row doc copy num gone body t words lines h s p worded good clean uid first src none each copies rank rows tie digest size check peer at_id group_size node stay stay_node fp b a key part component_id source_size target taken kept KEEP_ID n_words Clean_Text n_removed longest_run text_sha256 _stay _source _t _doc is_guess".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(d, t, s, 9, *[f"{c}{d}" for c in CLASHES]) for d, t, s, in EDGE]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", "n_chars long", *[f"`{c}` string" for c in CLASHES]]))


def test_columns_of_any_name_stay(clashing):
    def same(out, without=()):
        columns = [c for c in CLASHES if c.lower() not in without]
        for r in out.select("doc_id", *columns).collect():
            assert [r[c] for c in columns] == [f"{c}{r.doc_id}" for c in columns]
        return out.count()

    n = clashing.count()
    assert same(line_dedup(clashing, 3), ("n_removed", "longest_run")) == n
    assert same(exact_dedup(clashing), ("keep_id", "group_size", "kept", "text_sha256")) == n
    assert same(quality(clashing), ("n_words", "clean_text", "n_removed", "kept")) == n
    for keep in (simhash_dedup, shingle_dedup, apply_mix, quality_filter):
        out = keep(clashing)
        assert out.columns == clashing.columns
        same(out)
        assert keep(clashing.limit(0)).count() == 0
    for read in (lambda d: best_fit_pack(d, vocabulary()), mix, lambda d: read_token_files(write_token_files(d, vocabulary())), scan_secrets, simhash_groups):
        assert read(clashing).count() >= n and read(clashing.limit(0)).count() == 0
    pages = clashing.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))
    assert warc.read_archives(warc.write_archives(warc.deduplicate(pages))).count() == n
    out = identify(clashing.withColumn("lang", F.lit("en")), fit(clashing.withColumn("lang", F.lit("en"))))
    assert out.count() == n


class Caught:
    """Stands for a table, and for a task: the function that would run over it is called here, as a worker would."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run

    def partitionId(self):
        return 0


def own_mb() -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_packing_gives_memory_back(spark, monkeypatch):
    """A worker that has done its task holds little more than before, whatever passed through it."""
    monkeypatch.setattr(packing.TaskContext, "get", Caught)
    run, rng = pieces(Caught(), vocabulary()), random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 12))) for _ in range(3000)]

    def batches(n):
        for _ in range(n):
            texts = [" ".join(rng.choices(words, k=700)) for _ in range(2500)]
            yield pa.record_batch([pa.array(range(2500), pa.int64()), pa.array(texts)], ["doc_id", "text"])
            del texts

    def rows(n):
        return sum(out.num_rows for out in run(batches(n)))

    assert rows(0) == 0  # the vocabulary is loaded
    before = own_mb()
    assert rows(3) == 7500
    assert own_mb() - before < 25


def test_pipeline_stages_on_odd_rows(spark, clashing):
    import corpus_pipeline as P

    prose = " ".join(f"word{i * 37 % 101} and{i}" for i in range(30)) + "."
    rows = [(d, t, s, "en", 3) for d, t, s in EDGE] + [(50, prose, "A", "en", 1), (50, prose, "A", "en", 1), (51, prose, None, None, 1), (None, prose + " Tail.", "B", "en", 1)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size long"), clashing):
        docs0 = docs
        for _, stage in P.STAGES[:-1]:
            docs = cut(stage(spark, docs, ""))
            assert docs.columns == docs0.columns
        P.STAGES[-1][1](spark, docs, "").count()
        empty = docs0.limit(0)
        for _, stage in P.STAGES:
            assert stage(spark, empty, "").count() == 0


def kept_by_plain_rules(rows):
    """doc_id -> cleaned text of what the quality stage keeps, line by line."""
    out = {}
    for d, t in rows:
        words = re.findall(WORD, t or "")
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen = Counter(windows)
        covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
        if len(words) < 20 or 100 * len(covered) > 30 * len(words):
            continue
        stay = []
        for line in t.split("\n"):
            own = re.findall(WORD, line)
            bars, signs = len(re.findall(BARS, line)), len(re.findall(SIGNS, line))
            ends = re.search(rf"[{ENDS}]['\"”’»)\]]*[ \t\x0b-\r]*\Z", line)
            bad = not ends or bars and 3 * bars >= len(own) or 10 * signs > len(line) or len(line) <= SHORT and re.search(furniture(), line.lower())
            if not own or not bad:
                stay.append(line)
        left = "\n".join(stay)
        if sum(map(len, re.findall(WORD, left))) >= 0.5 * sum(map(len, words)):
            out[d] = left
    return out


@pytest.mark.skipif(not Path(DOCS).exists(), reason="no tables here")
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(DOCS)
    quality = P.quality_rules(spark, docs, "").cache()
    kept = kept_by_plain_rules([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.text for r in quality.collect()} == kept
    exact = P.exact(spark, quality, "").cache()
    assert exact.count() == quality.select("text").distinct().count()
    assert exact.join(exact.groupBy("text").agg(F.max("doc_id").alias("m")), "text").filter("doc_id <> m").isEmpty()
    near = P.near(spark, exact, "").cache()
    assert near.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in exact.collect()]
    assert {(r.doc_id, r.text) for r in near.collect()} == first_of_components(texts)
    taken = P.mixture(spark, near, "").cache()
    assert taken.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    packed = P.packing(spark, taken, "").cache()
    want = sum(len(ids_of(r.text)) + 1 for r in taken.collect())
    assert packed.agg(F.sum("length")).first()[0] == want
    assert packed.groupBy("row_id", "piece").count().filter("count > 1").isEmpty()
    run = P.run(spark, "/root/testdata/sf0.001")
    assert run.agg(F.sum("length"), F.count("*")).first() == packed.agg(F.sum("length"), F.count("*")).first()
