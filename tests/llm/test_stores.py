"""Archives, token shards, mixing and the pipeline: exact round trips and brute force."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plateau.llm import base, mixing, token_store, warc

PAGES = [
    (1, "http://www.example.com/b?x=1#top", "<p>" + "same " * 40 + "</p>"), (2, "https://a.example.com:80/", "<p>" + "same " * 40 + "</p>"), (3, None, None), (4, "", ""),
    (5, "not a url", "short"), (6, "http://www.example.com/b?x=1", "short"), (6, "http://www.example.com/b?x=1", "short"), (7, "http://é.example/\r\nX: y", "é" * 70),
    (8, "http://zz.example/", "é" * 70), (None, "http://no.id/", "é" * 70), (9, "http://big.example/", "z\U0001f600" * 400_000), (10, "http://user:pw@HOST.Example/p", "\r\n\r\n" * 60),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as key", "'y' as digest", "0 as first_id")


def test_captures_come_back_whole(spark):
    directory = warc.write_archive(pages(spark), base.new_path(spark, "warc"))
    payload = {i: (h or "").encode() for i, _, h in PAGES}
    first = {}
    for i, p in payload.items():
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    want = []
    for i, _, h in PAGES:
        p = (h or "").encode()
        again = p in first and first[p] != i
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    assert sorted((tuple(r) for r in warc.read_captures(directory).collect()), key=str) == sorted(want, key=str)


def test_index_lookup_reads_the_captures_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows = pages(spark)
    directory = warc.write_archive(rows.coalesce(1), base.new_path(spark, "warc"))
    keys = dict((r.page_id, r.k) for r in rows.select("page_id", warc.url_key(rows["url"]).alias("k")).collect())
    assert keys[1] == keys[6] == "com,example,www)/b?x=1" and keys[10] == "example,host)/p" and keys[3] == ""
    got = warc.lookup(directory, [keys[1], keys[9], "com,none)/"])
    assert sorted((g["page_id"], g["record_type"]) for g in got) == [(1, "response"), (6, "response"), (6, "response"), (9, "response")]
    assert next(g for g in got if g["page_id"] == 9)["payload"].decode() == PAGES[10][2]
    assert warc.write_archive(pages(spark, []), base.new_path(spark, "warc")).count() == 0


def test_stored_bytes_decide_how_many_tasks_read_them(spark):
    rows = spark.range(400).selectExpr("id as at", "id * 0 + 1000000L as bytes")
    out = base.spread(rows, "bytes", "at", target=4_000_000)
    sizes = out.mapInArrow(lambda batches: (b for b in [__import__("pyarrow").RecordBatch.from_pydict({"n": [sum(map(len, batches))]})]), "n bigint").collect()
    assert len([r.n for r in sizes if r.n]) >= 90 and sum(r.n for r in sizes) == 400
    directory = warc.write_archive(pages(spark, [(i, f"http://h{i}.example/", "x" * 500) for i in range(200)]).repartition(8), base.new_path(spark, "warc"))
    blocks = directory.count()
    parts = base.spread(directory, "bytes", "archive", "offset").withColumn("p", F.spark_partition_id())
    assert parts.select("p").distinct().count() >= min(blocks, 4)
    assert base.spread(rows.where("at < 0"), "bytes", "at").collect() == []


def test_a_damaged_record_is_noticed():
    record = warc._record(1, "http://a/", b"x" * 200, hashlib.sha256(b"y").hexdigest(), None, False)
    with pytest.raises(ValueError):
        warc.parse_record(record)


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_store.default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [2]


TRICKY = ["it's WE'LL don't", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "Á é", "ΣΑΣ İstanbul", "a b c\x0bd\x1ce", "ﬁ １２3 ½", "x" * 3000, "̀abc ̀", "日本語 テキスト", "a_b--c...d"]


def test_word_wise_encoding_is_that_of_whole_texts():
    enc = token_store.Encoder(token_store.default_tokenizer())
    for t in TRICKY + [r[1] for r in odd.ROWS if r[1]]:
        assert np.frombuffer(enc.batch([t])[0], enc.dtype).tolist() + [2] == reference_ids(t), t
    enc.cache, limit = {}, token_store.CACHE_WORDS
    token_store.CACHE_WORDS = 3
    try:
        assert [np.frombuffer(x, enc.dtype).tolist() + [2] for x in enc.batch(TRICKY)] == [reference_ids(t) for t in TRICKY]
    finally:
        token_store.CACHE_WORDS = limit


def test_capitals_that_compose_only_when_small_keep_their_marks():
    enc = token_store.Encoder(token_store.default_tokenizer())
    for pair in ("J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"):
        below, both = pair[0] + "\u0323" + pair[1], "\u00c9T\u0344 \u00c9COLE J\u0344"
        for t in (pair, f"a{pair}b Plain {pair}.", f"{pair.lower()} {pair}", f"{below} X\u00c9{below}", both):
            assert np.frombuffer(enc.batch([t])[0], enc.dtype).tolist() + [2] == reference_ids(t), t


def test_shards_round_trip_in_document_order(spark):
    rows = odd.ROWS + [(200 + k, t, "s") for k, t in enumerate(TRICKY)] + [(300 + k, odd.prose(50, k), "s") for k in range(60)]
    manifest, dictionary = token_store.write_tokens(odd.documents(spark, rows), base.new_path(spark, "tokens"))
    got = sorted((tuple(r) for r in token_store.read_digests(manifest, dictionary).collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    want, at = [], 0
    for i, t, _ in order:
        ids = reference_ids(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    found = []
    for r in manifest.collect():
        shard = token_store.Shard(r.file, dictionary)
        found += [x.tolist() for x in shard.find(2)]
        with pytest.raises(ValueError):
            token_store.Shard(r.file, b"another")
    assert found == [reference_ids(odd.ROWS[1][1])] * 2
    empty, none = token_store.write_tokens(odd.documents(spark, []), base.new_path(spark, "tokens"))
    assert none == b"" and token_store.read_digests(empty, none).collect() == []


def filled(sizes, weights, total):
    """Targets by sharing again and again what caps refuse."""
    target, left = {}, set(range(len(sizes)))
    while left:
        w = sum(weights[i] for i in left)
        over = [i for i in left if total * weights[i] / w > 2 * sizes[i] + 1e-9]
        if not over:
            return target | {i: total * weights[i] / w for i in left}
        for i in over:
            target[i] = 2.0 * sizes[i]
        total -= sum(target[i] for i in over)
        left -= set(over)
    return target


@pytest.mark.parametrize("per_range", [2, 4096])
def test_mix_meets_every_target_exactly(spark, per_range):
    rows = odd.ROWS + [(400 + k, odd.prose(5 + k % 40, k), ("src0", "src1", "b", "a", None)[k * k % 5]) for k in range(120)]
    docs = odd.documents(spark, rows)
    got = mixing.mix(docs, rows_per_range=per_range).collect()
    assert len(got) == len(rows)
    size, by = defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
    for i, t, s in rows:
        size[s] += len((t or "").encode().split())
    names = sorted((s for s in size if s is not None)) + [None]
    want = filled([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(size.values()))
    source = mixing.mix(docs, keep=["source"], rows_per_range=per_range).collect()
    for r in source:
        by[r["row"]["source"]] += r.taken
        assert r.source_size == size[r["row"]["source"]]
        assert math.isclose(r.target, want[names.index(r["row"]["source"])], abs_tol=1e-4)
    for k, s in enumerate(names):
        assert abs(by[s] - want[k]) <= 1
    assert Counter(map(str, got)) == Counter(map(str, mixing.mix(docs, rows_per_range=7).collect()))


def test_mixed_rows_are_whole_documents(spark):
    docs = odd.documents(spark)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    texts = {r[1] for r in odd.ROWS}
    assert all(r.text in texts for r in out.collect())
    assert mixing.mixed_rows(odd.documents(spark, [])).collect() == [] and mixing.mix(odd.documents(spark, [])).collect() == []


def test_pipeline_stages_on_odd_rows_and_nothing(spark, tmp_path):
    spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, odd.prose(30, 90))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.documents(spark, odd.ROWS + [(70, "see " + odd.prose(30, 90), "src0")])
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, str(tmp_path))
            rows = out.collect()
            assert out.columns == (["doc_id", "start", "n_tokens", "ids_crc32"] if name == "tokens" else docs.columns), name
            assert rows if frame is docs else not rows, name
            if name == "decontamination" and rows:
                assert 70 not in {r.doc_id for r in rows} and len(rows) == len(odd.ROWS)


def test_pipeline_runs_and_its_stages_are_the_dealt_ones(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert rows and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert os.path.exists("/root/testdata/sf0.001/documents.parquet")
