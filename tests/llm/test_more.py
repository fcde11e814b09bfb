"""Centroids, archives and ranked search against brute force."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PythonException

from sheetweave.llm import centroids, ranked_search, warc

# Centroids


def lloyd(rows: list[tuple], k: int, rounds: int, dims: int, scale: int) -> list[tuple]:
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "z", v) for i, v in kept)
    means = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for c, vs in groups.items():
            means[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = Counter()
    for _, c, d in placed:
        own[c] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, own[c], sum(own.values()), sha[c]) for i, c, d in placed), key=repr)


@pytest.mark.parametrize(("n", "spread", "block", "k"), [(0, 1, 4096, 4), (3, 1, 4096, 16), (700, 0.02, 64, 5), (900, 2.0, 100, 16), (300, 0.0, 4096, 8)])
def test_centroids(spark, monkeypatch, n, spread, block, k):
    """Crowded, loose and equal vectors, ties, repeated and null ids, vectors that don't count, a clashing column."""
    monkeypatch.setattr(centroids, "BLOCK", block)
    r = random.Random(n)
    middles = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i % (n - 5) if n > 5 else i, [x + r.gauss(0, spread) for x in r.choice(middles)]) for i in range(n)]
    if n > 5:
        rows += [(None, [0.5] * 6), (None, [0.5] * 6), (7001, None), (7002, [1.0] * 5), (7003, []), (7004, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (7005, [float("nan")] * 6), (7006, [float("inf")] * 6), (7007, [-0.01] * 6), (7007, [-0.01] * 6)]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    got = centroids.cluster(df, k=k, rounds=3, dims=6)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == lloyd(rows, k, 3, 6, 64)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}


def test_filtering_prunes_and_assigns_nodes():
    r = np.random.default_rng(1)
    points = np.concatenate([r.normal(0, 3, (500, 4)), r.normal(400, 3, (500, 4))]).astype(np.int64)
    tree, order = centroids.Tree.over(points)
    means = np.array([[0] * 4, [400] * 4, [9000] * 4])
    steps = list(tree.filtered(means))
    whole = sum(int((tree.stop[at] - tree.start[at]).sum()) for at, _, w in steps if w)
    assert whole == 1000  # nothing is left for the leaves
    assert (tree.labels(means) == (points[order] > 200).all(1)).all()
    count, sums = tree.totals(means)
    assert count.tolist() == [500, 500, 0]
    assert (sums[1] == points[500:].sum(0)).all()


def test_components_out_of_range_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(PythonException, match="beyond"):
        centroids.cluster(df, dims=2).collect()


# Archives


def pages(spark):
    rows = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, "same"), (4, "u\r\nX: y", None), (2, "http://b", ""), (1, "http://c", "é" * 9), (8, "http://d", "x" * 300_000), (8, "http://d", "x" * 300_000), (None, "n", "same"), (None, "n", "alone"), (6, "http://e", "WARC/1.1\r\n\r\n" * 3)]
    return rows, spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, record_type string, payload int").repartition(3)


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_archive_round_trip(spark, monkeypatch, least, limit):
    monkeypatch.setattr(warc, "BROADCAST", limit)
    rows, df = pages(spark)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        first = min(ids) if ids and len(body) >= least and sum((h or "").encode() == body for _, _, h in rows) > 1 else None
        back = first is not None and i != first
        want.append((i, len(body), warc.base32_sha1(body), "revisit" if back else "response", first if back else None))
    assert sorted((tuple(r) for r in warc.round_trip(df, least).collect()), key=repr) == sorted(want, key=repr)


def test_archive_of_an_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    _, df = pages(spark)
    warc.archive(df, str(tmp_path / "a"))
    whole = spark.read.format("warc").load(str(tmp_path / "a"))
    part = whole.where("record_type = 'revisit' and target_uri like 'http://a%' and not refers_to = 'x' and date is not null")
    plan = spark._jvm.PythonSQLUtils.explainString(part._jdf.queryExecution(), "formatted")
    assert "EqualTo(record_type,revisit), StringStartsWith(target_uri,http://a)" in plan and "Filter" not in plan.split("PushedFilters")[0]
    assert {warc_id for (warc_id,) in part.select("record_id").collect()} == {"<urn:page:5>"}
    heads = spark.read.format("warc").option("payload", "false").option("header.WARC-Type", "response").load(str(tmp_path / "a")).collect()
    assert len(heads) == 7 and all(r["payload"] is None and r["payload_bytes"] is None for r in heads)


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


@pytest.mark.parametrize("packed", [True, False])
def test_unwanted_records_are_jumped_over(packed):
    noise = random.Random(3).randbytes(3_000_000)
    data = b"".join(warc.written({"record_type": kind, "record_id": f"<urn:page:{i}>", "payload": noise}, packed) for i, kind in enumerate(["response", "resource", "response"]))
    file = Counting(data)
    got = list(warc.records(file, lambda row, headers: row["record_type"] == "resource", False, False))
    assert [r["record_id"] for r in got] == ["<urn:page:1>"]
    assert file.taken < 600_000 < len(data)
    got = list(warc.records(io.BytesIO(data), lambda row, headers: row["record_type"] == "resource", True, True))
    assert [r["payload"] for r in got] == [noise]


def test_foreign_archives(spark, tmp_path):
    """Folded headers, chunked payloads, other types, gzip members without the extra field, no manifest."""
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nsoft\r\n\r\n"
    reply = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID:\r\n  <b>\r\nContent-Type: application/http;\r\n\tmsgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    (tmp_path / "x.warc").write_bytes(info + reply)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(reply))
    (tmp_path / "notes.txt").write_text("no archive")
    warc.register(spark)
    df = spark.read.format("warc").load(str(tmp_path))
    assert sorted((r["record_id"], bytes(r["payload"]), r["payload_bytes"]) for r in df.collect()) == [("<a>", b"soft", 4)] * 2 + [("<b>", b"abcde", 5)] * 2
    assert df.where("record_type = 'response'").count() == 2
    (tmp_path / "z.warc").write_bytes(reply[:-20])
    with pytest.raises(PythonException, match="z.warc at 0"):
        df = spark.read.format("warc").load(str(tmp_path / "z.warc"))
        df.collect()


def test_files_of_lost_tasks_are_not_read(spark, tmp_path):
    _, df = pages(spark)
    path = str(tmp_path / "a")
    warc.archive(df, path)
    (tmp_path / "a" / f"{uuid.uuid4().hex}.warc.gz").write_bytes(b"half a rec")
    assert spark.read.format("warc").load(path).count() == 11


def test_a_wrong_digest_is_an_error(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(warc.written({"payload": b"abc", "payload_digest": "A" * 32}, False))
    warc.register(spark)
    with pytest.raises(PythonException, match="digest"):
        spark.read.format("warc").option("verify", "true").load(str(tmp_path)).collect()


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    spoken, words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * spoken // max(words, 1)
            score = sum(n * math.floor(1000 * math.log((2 * spoken + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, n in asked.items() if c[w])
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def corpus(n: int) -> list[tuple]:
    r = random.Random(n)
    words = [f"w{i}" for i in range(60)] + ["Éa", "ÉA", "x-y", "a1"]
    docs = [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(len(words))], k=r.randrange(1, 40)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)]  # equal scores
    return [*docs, (4, docs[4][1]), (None, docs[5][1]), (None, None), (900, None), (901, ""), (902, " .,-\n"), (903, "w1 " * 9000), (904, "W3 w3 É\x7fa")]


@pytest.mark.parametrize(("shard", "sent", "k"), [(1 << 24, 1 << 25, 20), (600, 1 << 25, 3), (300, 600, 5)])
def test_ranked_search(spark, monkeypatch, shard, sent, k):
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    monkeypatch.setattr(ranked_search, "BROADCAST", sent)
    monkeypatch.setattr(ranked_search, "PER_BLOCK", 2)
    docs = corpus(150)
    items = [(1, "w1 w2 w3"), (2, docs[3][1]), (3, "w50 w1 w1 W1 éa ÉA"), (4, None), (5, ""), (6, "unknown words"), (7, "w59"), (7, "w59"), (7, "w58 w0"), (None, "w5, w6"), (8, " ".join(t for _, t in docs[:30]))]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, score int, terms string").repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    got = ranked_search.search(ranked_search.build(d), q, k)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(docs, items, k)


def test_search_of_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items in ((no_docs, asked), (some, no_items), (no_docs, no_items), (spark.createDataFrame([(1, None)], "doc_id long, text string"), asked)):
        assert ranked_search.search(ranked_search.build(docs), items).collect() == []


def test_best_is_exact_and_skips():
    r = np.random.default_rng(5)
    for _ in range(60):
        n, k, floor = int(r.integers(1, 80)), int(r.integers(1, 9)), int(r.integers(0, 60))
        lists = []
        for _ in range(int(r.integers(0, 7))):
            docs = np.flatnonzero(r.random(n) < r.random())
            adds = r.integers(1, int(r.choice([3, 60])), len(docs))
            if len(docs):
                lists.append((docs, adds, int(adds.max())))
        score = np.zeros(n, np.int64)
        for docs, adds, _ in lists:
            score[docs] += adds
        kth = np.sort(score)[-k] if n >= k else 0
        want = {(i, s) for i, s in enumerate(score.tolist()) if s >= max(kth, floor, 1)}
        at, got = ranked_search.best(lists, n, k, floor)
        assert set(zip(at.tolist(), got.tolist(), strict=True)) == want


# Queries' columns

COLUMNS = {
    "op11_kd_centroids": ("embeddings", {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}),
    "op12_warc": ("pages", {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}),
    "op13_maxscore": (None, {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_queries(spark, sf_dir, name):
    from sheetweave.llm.queries import QUERIES

    table, types = COLUMNS[name]
    got = QUERIES[name](spark, sf_dir)
    assert dict(got.dtypes) == types
    if table:
        assert got.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
