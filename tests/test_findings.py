"""Queries against their SQL on small tables of a kind that the given ones lack, and the pieces of work of large ones."""

import os
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.operators import bits as joins
from gleaner.operators import blocks, similarity
from gleaner.plans import queries
from gleaner.plans.oracle import ORACLE
from gleaner.plans.queries import QUERIES
from gleaner.sinks import reports
from tests.oracle import SF, TABLES, same


def folder_with(at, **tables):
    """The tables of the smallest folder, some of them replaced."""
    for t in TABLES:
        if t in tables:
            pq.write_table(tables[t], f"{at}/{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{at}/{t}.parquet")
    return str(at)


def test_outlines_of_cut_references(spark, tmp_path):
    titles = ["a &amp; b", "a &amp;&amp", "say &quot;x&quot", "&amp;lt;", "&#65;", ""]
    html = [f'<title>{t}</title><h1>{t}</h1><p>x<p><a href="y">{t}</a><article></article>' for t in titles] + ["<p>no title", "", None]
    pages = pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": pa.array(["http://a.b/c"] * len(html)), "html": pa.array(html, pa.string())})
    same(spark, QUERIES["page_outlines"], ORACLE["page_outlines"], folder_with(tmp_path, pages=pages))


def documents(texts):
    n = len(texts)
    return pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * n), "source": pa.array(["s"] * n), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})


def test_grids_of_odd_texts(spark, tmp_path):
    """Spaces of ASCII only, code points of up to four bytes, nulls, texts without words, and rows of one id."""
    texts = ["a bb\tccc\x0bd\x0ce\r\nf", " x  y", "ä öö 漢字 😀😀 é", "", None, "   ", " a", "a ", "x" * 300, "a\x1cb \x1f", *(f"w{k} " * (k % 7) + "é" * k for k in range(60))]
    docs = documents(texts * 2)
    twice = docs.set_column(0, "doc_id", pa.array([k % 100 for k in range(len(docs))], pa.int64()))
    for at, table in ((tmp_path / "one", docs), (tmp_path / "two", twice)):
        at.mkdir()
        folder = folder_with(at, documents=table)
        for name in ("hamming_wide", "hamming_wide_close", "hamming_wide_turned", "hamming_pairs_indexed"):
            same(spark, QUERIES[name], ORACLE[name], folder)


def test_near_hashes_are_made_once(spark):
    """Where many hashes are near, nothing comes after the tasks that compare them: no join and no second look for equal pairs."""
    df = spark.createDataFrame([(k, [k % 64, 0, 0, 0]) for k in range(500)], "k long, h array<long>")
    pairs = similarity.hamming_pairs(df, "k", "h", 20, bits=256)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert pairs.count() == 500 * 499 // 2 and pairs.distinct().count() == 500 * 499 // 2


@pytest.mark.parametrize("most", [5, 64, 32768])
@pytest.mark.parametrize(("threshold", "bits"), [(0, 64), (1, 64), (2, 64), (6, 64), (18, 64), (2, 256), (10, 256)])
def test_skewed_hashes_with_groups(spark, monkeypatch, threshold, bits, most):
    """Hashes of few set bits with many copies, in bands and in blocks of any size; a pair has two keys and two groups."""
    monkeypatch.setattr(similarity, "CROWD", most)
    monkeypatch.setattr(joins, "PACK", min(most, 1024))
    r = random.Random(threshold)
    hashes = [sum(1 << b for b in r.sample(range(bits), r.choice((0, 0, 1, 2, 5, 30)))) for _ in range(150)] * 2 + [0] * 40
    group = [r.choice((1, 2, 3, None)) for _ in hashes]
    far = lambda i, j: (hashes[i] ^ hashes[j]).bit_count()
    near = {(f"{i:03}", f"{j:03}"): far(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if far(i, j) <= threshold}
    words = lambda h: [(lambda w: w - (1 << 64) if w >> 63 else w)(h >> 64 * k & (1 << 64) - 1) for k in range(bits // 64)]
    rows = [(f"{k:03}", words(h) if bits > 64 else words(h)[0], g) for k, (h, g) in enumerate(zip(hashes, group, strict=True))]
    df = spark.createDataFrame(rows, f"k string, h {'array<long>' if bits > 64 else 'long'}, g int")
    got = [((p.a, p.b), p.distance) for p in similarity.hamming_pairs(df, "k", "h", threshold, bits=bits).collect()]
    assert len(got) == len(near) and dict(got) == near
    want = {(a, b, group[int(a)], group[int(b)], d) for (a, b), d in near.items() if None not in (group[int(a)], group[int(b)]) and group[int(a)] != group[int(b)]}
    found = [tuple(p) for p in similarity.hamming_pairs(df, "k", "h", threshold, "g", bits).select("a", "b", "group_a", "group_b", "distance").collect()]
    assert len(found) == len(want) and set(found) == want


def test_no_hashes_are_broadcast(spark, tmp_path):
    """The driver gets a sample of hashes and counts, not tables of them, whatever the planner takes for small."""
    plan = QUERIES["hamming_pairs_banded"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    rows = [(k, k >> 3, k % 25) for k in range(1, 3000)]
    hashes = [h ^ n << 40 for _, h, n in rows]
    want = {(i + 1, j + 1) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= 1}
    customer = pa.table({"c_custkey": pa.array([k for k, _, _ in rows], pa.int64()), "c_nationkey": pa.array([n for _, _, n in rows], pa.int32())})
    got = [(p.a, p.b) for p in QUERIES["hamming_pairs_banded"](spark, folder_with(tmp_path, customer=customer)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_results_are_made_in_batches(spark, monkeypatch):
    """A task holds two blocks and a batch of pairs, not what comes of them: 600 copies of two near hashes, and many of few copies."""
    monkeypatch.setattr(joins, "BATCH", 100)
    monkeypatch.setattr(joins, "PACK", 50)
    hashes = [0] * 300 + [1] * 300 + [k % 40 << 8 for k in range(120)]
    want = sum((a ^ b).bit_count() <= 6 for k, a in enumerate(hashes) for b in hashes[:k])
    pairs = similarity.hamming_pairs(spark.createDataFrame(list(enumerate(hashes)), "k long, h long"), "k", "h", 6)
    got = [(p.a, p.b) for p in pairs.collect()]
    assert len(got) == len(set(got)) == want
    assert all(p.distance == (hashes[p.a] ^ hashes[p.b]).bit_count() for p in pairs.limit(1000).collect())


def test_pairs_are_verified_where_they_are_found(spark, monkeypatch):
    plan = QUERIES["verified_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]
    monkeypatch.setattr(blocks, "TILE", 16)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 100)
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(150)]
    made = [(k, None if k % 11 == 0 else [r.random() for _ in range(3)], None if k % 13 == 0 else [r.random() * 30 for _ in range(5)]) for k in range(140)]
    for kind in ("float", "double"):
        df, features = spark.createDataFrame(rows, f"k int, v array<{kind}>"), spark.createDataFrame(made, "k int, h array<double>, g array<double>")
        pairs = similarity.cosine_pairs(df, "k", "v", 0.3).select("a", "b")
        for tests in ({"least_histogram": 1.0}, {"least_histogram": -1, "most_difference": 9.0, "most_pixels": 0.2}, {"least_histogram": 0.5, "most_difference": -1, "pixel_difference": 12.0, "most_pixels": 0.4}, {"least_histogram": -1, "most_difference": -1, "most_pixels": -1}):
            want = sorted(tuple(p) for p in similarity.verified_pairs(pairs, features, "k", "h", "g", **tests).select("a", "b", "histogram", "difference", "ratio").collect())
            got = sorted(tuple(p) for p in similarity.verified_cosine_pairs(df, features, "k", "v", 0.3, "h", "g", **tests).select("a", "b", "histogram", "difference", "ratio").collect())
            assert want and got == want


def test_pairs_of_a_report_are_sorted_once(spark, monkeypatch):
    """Only pairs, and the counts of two folders each, are ranked: not the lines, of which a pair has four."""
    sizes, rank = [], reports.global_rank
    monkeypatch.setattr(reports, "global_rank", lambda df, *a: sizes.append(df.count()) or rank(df, *a))
    rows = [(f"f{k % 3}", f"n{k}", f"f{k % 3 + k % 2 + 1}", f"m{k}", k % 19) for k in range(50)]
    df = spark.createDataFrame(rows, "folder_a string, name_a string, folder_b string, name_b string, distance int")
    got = sorted(tuple(r) for r in reports.similar_report(df, [F.col("name_a")], "r").collect())
    two = sorted({" <-> ".join(sorted(r[0:3:2])) for r in rows})
    assert [k for k, _ in got] == list(range(1, 4 + 4 * 50 + 2 + len(two) + 4 + 1)) and sizes == [50, len(two)]
    values = [v for _, v in got]
    assert values[1] == reports.FOUND % 50
    for k, r in enumerate(sorted(rows, key=lambda r: r[1])):
        assert values[4 + 4 * k : 8 + 4 * k] == [reports.PAIR % (k + 1, r[4], " <-> ".join(sorted(r[0:3:2]))), reports.MEMBER % r[0:2], reports.MEMBER % r[2:4], ""]
    assert values[206 : 206 + len(two)] == [reports.BETWEEN_COUNT % (t, sum(" <-> ".join(sorted(r[0:3:2])) == t for r in rows)) for t in two]
    assert values[-1] == reports.FOLDER_NAMES % ("r", ", ".join(sorted({x for r in rows for x in r[0:3:2]})))


def test_images_are_read_a_few_files_at_once(spark, tmp_path, monkeypatch):
    """The driver's reader is given at most so many files at once, however many there are; the paths are the files' own."""
    from gleaner.sinks.images import png
    from gleaner.sources import files

    for k in range(23):
        at = tmp_path / f"in/{k % 3}" / ("deep" if k % 2 else "")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"v{k}.png").write_bytes(b"no image" if k % 7 == 0 else png(2, 1, 1, bytes([k, k])))
    (tmp_path / "in/note.txt").write_text("x")
    found = files.listed_files(spark, str(tmp_path / "in"))
    assert {(r.path, r.filename, r.ext) for r in found.collect()} == {(str(p), p.name, ".png") for p in (tmp_path / "in").rglob("*.png")}
    assert files.listed_files(spark, str(tmp_path / "in"), None).count() == 24
    given, scan = [], files.scan_images
    monkeypatch.setattr(files, "scan_images", lambda s, folders: given.append(sum(len(os.listdir(f)) for f in folders)) or scan(s, folders))
    got = {r.path: r.data and bytes(r.data) for r in files.decoded_images(found, 4).collect()}
    want = {re.sub("^file:/+", "/", r.path): r.data and bytes(r.data) for r in scan(spark, str(tmp_path / "in")).where("path not like '%.txt'").collect()}
    assert got == want and sum(d is None for d in got.values()) == 4
    assert sum(given) == 23 and max(given) <= 4
    monkeypatch.setattr(queries, "scan_images", None)  # the query lists and decodes by these alone
    monkeypatch.setattr(queries, "scan_files", None)
    given.clear()
    same(spark, QUERIES["converted_images"], ORACLE["converted_images"])
    assert given
