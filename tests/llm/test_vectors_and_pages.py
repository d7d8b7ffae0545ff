"""Embedding near-duplicates, top-k search and WARC assembly against brute force."""

import base64
import gzip
import hashlib

import numpy as np
import pytest

from codelens_spark.llm import forest, voronoi
from codelens_spark.llm.forest import near_duplicates
from codelens_spark.llm.voronoi import topk_inner_product
from codelens_spark.llm.warc import assemble, page_captures, parse, read_records, write_captures

SCHEMA = "vec_id long, embedding array<float>, label int, pos long"
NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 7) for i, v in rows], SCHEMA.replace("float", kind))


def clustered(n=400, d=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(i, centres[i % 12] + rng.normal(scale=rng.choice([0.02, 0.15, 0.3]), size=d) if i % 3 else rng.normal(size=d)) for i in range(n)]
    rows += [(n + i, rows[1][1]) for i in range(30)] + [(n + 40 + i, rows[1][1] * 2.0) for i in range(3)]
    return [(i, np.asarray(v, np.float32)) for i, v in rows]


ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [NAN] + [1.0] * 15), (904, [INF] + [1.0] * 15), (905, [None] + [1.0] * 15), (906, [1.0, 2.0])]


def links_of(rows):
    ids = np.array([i for i, _ in rows])
    v = np.array([r for _, r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    label = ids.copy()
    for _ in range(len(ids)):
        new = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return dict(zip(ids.tolist(), near.sum(axis=1).tolist())), dict(zip(ids.tolist(), label.tolist()))


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "LEAF", 40)
    rows = clustered()
    count, label = links_of(rows)
    out = near_duplicates(table(spark, rows + ODD).repartition(5)).collect()
    found = {r["vec_id"]: r for r in out}
    assert len(out) == len(rows) + len(ODD)
    assert all(found[i]["n_links"] <= n for i, n in count.items())  # none below the threshold, none counted twice
    assert sum(found[i]["n_links"] for i in count) >= 0.97 * sum(count.values())
    assert np.mean([found[i]["component_id"] == c for i, c in label.items()]) > 0.99
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"] for i, _ in ODD)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("cosine", [0.96, 0.97, 0.98])
def test_embedding_dense_group(spark, cosine):
    """A third of all rows near each other, not equal."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(6000, 64))
    centre = rng.normal(size=64)
    v[:2000] = centre / np.linalg.norm(centre) + rng.normal(scale=np.sqrt((1 / cosine - 1) / 64), size=(2000, 64))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    out = near_duplicates(table(spark, list(enumerate(v)), "double")).collect()
    found = {r["vec_id"]: r["n_links"] for r in out}
    assert all(found[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(found.values()) >= 0.97 * want.sum() > 1e6
    assert {r["component_id"] for r in out if want[r["vec_id"]]} == {min(i for i in found if want[i])}


def test_embedding_odd_tables(spark):
    assert near_duplicates(table(spark, [])).collect() == []
    assert [r["n_links"] for r in near_duplicates(table(spark, ODD)).collect()] == [0] * len(ODD)
    big = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [-1.0, 1.0]), (None, [1.0, 1.0]), (3, [-1.0, 1.0])]
    out = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in near_duplicates(table(spark, big, "double")).collect())
    assert out == [(0, 0, None), (1, 1, 1), (2, 1, 1), (3, 1, 3), (3, 1, 3)]


@pytest.mark.parametrize("sizes", [(1024, 16_384, 256, 4096), (8, 50, 10, 64)])
def test_topk(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK_QUERIES", "CHUNK_ROWS", "PIVOTS", "SAMPLE"), sizes):
        monkeypatch.setattr(voronoi, name, value)
    rows = clustered() + [(700 + i, np.full(16, 0.25, np.float32)) for i in range(60)] + [(800, np.zeros(16, np.float32)), (820, np.zeros(16, np.float32))]
    vectors = table(spark, rows + [r for r in ODD if r[0] != 902])
    out = topk_inner_product(vectors.filter("vec_id % 20 = 0"), vectors, 20).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(64 * np.asarray(v, float)).astype(int) for i, v in rows}
    for q in [i for i in whole if i % 20 == 0]:
        ranked = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:20]
        assert got[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    assert set(got) == {i for i in whole if i % 20 == 0}


def test_topk_odd_tables(spark):
    none = table(spark, [])
    few = table(spark, [(20, [1.0, 2.0]), (1, [3.0, 4.0]), (1, [3.0, 4.0]), (None, [1.0, 1.0])])
    assert topk_inner_product(few, none).collect() == topk_inner_product(none, few).collect() == []
    out = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk_inner_product(few.filter("vec_id = 20"), few).collect())
    assert out == [(1, 1, 64 * 192 + 128 * 256), (2, 1, 64 * 192 + 128 * 256)]
    huge = table(spark, [(20, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e12, 5.0])], "double")
    assert [r["score"] for r in sorted(topk_inner_product(huge.filter("vec_id = 20"), huge).collect(), key=lambda r: r["rank"])] == [2**63 - 1, -(2**63)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, file string")


def test_leaves_of_a_thin_sample_are_cut_further(spark, monkeypatch):
    """A forest from 150 vectors of 6000 leaves some hundreds of rows in a leaf; one group is dense and stays whole."""
    monkeypatch.setattr(forest, "LEAF", 40)
    monkeypatch.setattr(forest, "LEAF_SAMPLE", 100)
    monkeypatch.setattr(forest, "ROUTED_ROWS", 70)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(700, 16))
    rows = [(i, (centres[i % 700] + rng.normal(scale=rng.choice([0.05, 0.12, 0.4]), size=16)).astype(np.float32)) for i in range(5200)]
    rows += [(6000 + i, (centres[0] * 3 + rng.normal(scale=0.3, size=16)).astype(np.float32)) for i in range(800)]
    sizes = []
    kept = forest._refined

    def watched(routed, *rest):
        out = kept(routed, *rest)
        for df in (routed, out):
            sizes.append(sorted(r["count"] for r in df.selectExpr("explode(leaves) as leaf").groupBy("leaf").count().collect()))
        return out

    monkeypatch.setattr(forest, "_refined", watched)
    out = near_duplicates(table(spark, rows).repartition(4), sample=150).collect()
    before, after = sizes
    assert np.median(after) < 160 < np.median(before)
    count, label = links_of(rows)
    found = {r["vec_id"]: r for r in out}
    assert len(out) == len(rows) and all(found[i]["n_links"] <= n for i, n in count.items())
    assert sum(found[i]["n_links"] for i in count) >= 0.97 * sum(count.values())
    assert np.mean([found[i]["component_id"] == c for i, c in label.items()]) > 0.97


PAGES = [
    (1, "http://a/", "<p>x</p>", None, None), (2, "http://b/ c\r\nInjected: 1", "<p>x</p>", None, None), (5, None, "<p>x</p>", None, None), (3, "http://d/", None, None, None), (4, "u", "", None, None),
    (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 5000, None, None), (None, "u", "lost", None, None), (7, "u", "same", None, None), (7, "u", "same", None, None), (8, "u", "one", None, None), (8, "u", "other", None, None),
]


def test_captures(spark):
    out = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in page_captures(pages(spark, PAGES)).collect()), key=repr)
    want = []
    for i, html in [(r[0], r[2] or "") for r in PAGES]:  # a row for each row
        raw = html.encode()
        leader = max((r[0] for r in PAGES if r[0] is not None and (r[2] or "") == html), default=None)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if leader == i else "revisit", None if leader == i else leader))
    assert out == sorted(want, key=repr)
    assert page_captures(pages(spark, [])).collect() == []


def test_records_and_nested_rows(spark, tmp_path):
    files = write_captures(pages(spark, PAGES[:5]), f"file://{tmp_path}/w")
    records = read_records(files)
    assert records.count() == 15 and records.filter("type = 'response'").count() == 2
    whole = b"".join(gzip.open(p).read() for p in (tmp_path / "w").iterdir() if p.suffix == ".gz")
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == 15 and b"\r\nInjected" not in whole
    nested = assemble(records)
    assert nested.count() == 5 and nested.filter("orphan").count() == 0
    one = nested.filter("response.payload = encode('<p>x</p>', 'utf-8')").first()
    assert len(one["requests"]) == len(one["metadata"]) == 1 and one["response"]["type"] == "response"
    lonely = assemble(records.filter("type = 'request'"))
    assert lonely.count() == 5 and lonely.filter("orphan and response is null").count() == 5
    # the response may name its request instead
    turned = records.selectExpr("file", "at", "record_id", "type", "case when type = 'response' then 'urn:q' end as concurrent_to", "target", "date", "payload_digest", "payload_bytes", "refers_to", "fields", "payload").filter("type = 'response'").limit(1)
    asked = turned.selectExpr("file", "at", "'urn:q' as record_id", "'request' as type", "null as concurrent_to", "target", "date", "payload_digest", "payload_bytes", "refers_to", "fields", "payload")
    pair = assemble(turned.unionByName(asked)).collect()
    assert len(pair) == 1 and len(pair[0]["requests"]) == 1 and not pair[0]["orphan"]


def test_damage_is_seen(spark, tmp_path):
    with pytest.raises(ValueError):
        parse(b"no record")
    files = write_captures(pages(spark, PAGES[:1]), f"file://{tmp_path}/w")
    path = files.first()["file"].removeprefix("file://")
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:-20])
    with pytest.raises(Exception):
        read_records(files).collect()
