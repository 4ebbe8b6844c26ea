"""Boundaries of the operators on hand-made rows."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.functions import images, media, text, vectors
from gleaner.functions.ranges import range_of
from gleaner.operators import blocks, classify, membership, quality, ranking, similarity
from gleaner.operators.cluster import cluster_complete_linkage, cosine_components
from gleaner.operators.graph import connected_components
from gleaner.operators.phrases import phrase_rank, phrase_report
from gleaner.sinks import actions
from gleaner.sources import files, pages
from gleaner.streaming import first_seen as stream


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (4, 5)], [(9, 1), (9, 2), (9, 3)], [(1, 2), (2, 3), (3, 1), (7, 8)], [], [(4, 4), (None, 3)], [(i, i + 1) for i in range(70)]])
def test_components(spark, edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    want = {x: find(x) for x in list(top)}
    for few in (0, 3, 200_000):  # by rounds alone, by rounds and one task, by one task
        got = connected_components(spark.createDataFrame(edges, "src long, dst long"), few=few)
        assert {r.node: r.component for r in got.collect()} == want


@pytest.mark.parametrize(("threshold", "crowd"), [(0, 2048), (2, 2048), (2, 3), (10, 4), (20, 2048), (20, 5), (40, 2048)])
def test_wide_hashes_are_all_paired(spark, monkeypatch, threshold, crowd):
    """256 bits: bands within and across words, with a bit turned over, of crowds, and none at all."""
    monkeypatch.setattr(similarity, "CROWD", crowd)
    r = random.Random(threshold)
    base = [r.getrandbits(256) for _ in range(12)] + [r.getrandbits(64) << 192, 1 << 255]
    hashes = [h ^ sum(1 << b for b in r.sample(range(256), r.randrange(0, 24))) for h in base for _ in range(9)] + base + base[:3]
    words = lambda h: [(lambda w: w - (1 << 64) if w >> 63 else w)(h >> 64 * k & (1 << 64) - 1) for k in range(4)]
    want = {(i, j): (hashes[i] ^ hashes[j]).bit_count() for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= threshold}
    df = spark.createDataFrame([*((k, words(h)) for k, h in enumerate(hashes)), (900, None), (901, [1, None, 2, 3]), (902, [1])], "k long, h array<long>")
    got = [((p.a, p.b), p.distance) for p in similarity.hamming_pairs(df, "k", "h", threshold, bits=256).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_bands_hold_the_pigeonhole_rule():
    for bits in (64, 256):
        for t in range(1, 60):
            found = similarity.bands(t, bits)
            assert found is None or found[0] * (found[1] + 1) > t and bits // found[0] >= similarity.NARROWEST
    assert similarity.bands(2, 256) == (3, 0) and similarity.bands(10, 256) == (11, 0) and similarity.bands(20, 256) == (11, 1) and similarity.bands(6, 64) == (4, 1) and similarity.bands(14, 64) is None


def test_fewer_pairs_are_compared_at_higher_thresholds(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    n = e.count()
    shares = [similarity.cosine_pairs(e, "vec_id", "embedding", t, count=True).agg(F.sum("compared")).first()[0] / (n * (n - 1) / 2) for t in (0.4, 0.8, 0.95)]
    assert shares[0] > 0.9 and shares[1] < 0.05 and shares[2] < 0.05


def test_blocks_are_as_few_as_their_rows_need(spark):
    """2000 vectors of 64 doubles are one block, so one pair of blocks."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert similarity.cosine_pairs(e, "vec_id", "embedding", 0.4, count=True).count() == 1


@pytest.mark.parametrize("threshold", [0, 1, 2, 4, 7, 14])
def test_banded_pairs_are_all_pairs(spark, threshold):
    r = random.Random(threshold)
    base = [r.getrandbits(64) for _ in range(30)]
    hashes = [h ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for h in base for _ in range(6)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    want = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= threshold}
    df = spark.createDataFrame([*enumerate(signed), (999, None)], "k long, h long")
    got = [(p.a, p.b) for p in similarity.hamming_pairs(df, "k", "h", threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_bits_of_negative_hashes(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 3, 2), (-1, 0, 64), (-1, -2, 1), (5, 2, 3)], "a long, b long, n int")
    assert all(r.d == r.n for r in rows.select("n", vectors.hamming(F.col("a"), F.col("b")).alias("d")).collect())
    words = spark.createDataFrame([([0, -1, 7, 0], [0, 0, 0, 1])], "a array<long>, b array<long>")
    assert words.select(vectors.hamming_words(F.col("a"), F.col("b")).alias("d")).first().d == 68


def test_best_of_group_breaks_ties_by_bytes_then_name(spark):
    df = spark.createDataFrame([(1, 2, 8, 5, "b"), (1, 4, 4, 5, "a"), (1, 4, 4, 9, "c"), (2, 1, 1, 1, "z")], "g long, w long, h long, s long, n string")
    got = ranking.best_of_group(df, "g", "w", "h", "s", "n")
    assert [r.n for r in got.where("g = 1").orderBy("rank").collect()] == ["c", "a", "b"]
    totals = ranking.redundancy_totals(got, "g", "s").first()
    assert (totals.n_groups, totals.n_redundant, totals.redundant_bytes) == (1, 2, 10)


def test_verification_tests_and_defaults(spark):
    f = spark.createDataFrame([(1, [0.5, 0.5], [0.0, 0.0]), (2, [0.5, 0.5], [10.0, 10.0]), (3, None, None)], "k long, h array<double>, g array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    keep = lambda **x: [(p.a, p.b) for p in similarity.verified_pairs(pairs, f, "k", "h", "g", **x).collect()]
    assert keep() == [(1, 2)]  # a mean difference of exactly 10 passes
    assert keep(most_difference=9.9) == []
    assert sorted(keep(least_histogram=-1, most_difference=-1, most_pixels=-1)) == [(1, 2), (1, 3)]


def test_ranks_over_the_whole_table(spark):
    df = spark.createDataFrame([(i, i * 7 % 50) for i in range(200)], "k long, v long").repartition(7)
    got = ranking.global_rank(df, [F.desc("v"), F.asc("k")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 201))
    assert [(r.v, r.k) for r in got] == sorted(((i * 7 % 50, i) for i in range(200)), key=lambda x: (-x[0], x[1]))
    assert [ranking.top_fraction(df.limit(n), [F.asc("k")], 0.2).count() for n in (1, 5, 6)] == [1, 1, 2]
    assert ranking.global_rank(df.limit(0), [F.asc("k")]).count() == 0


def test_modes_and_names(spark):
    df = spark.createDataFrame([("d", 2, 8, "b"), ("d", 4, 4, "a"), ("e", None, None, "x")], "g string, w int, h int, p string")
    assert [tuple(r) for r in ranking.mode_of_group(df, "g", "w", "h", "p").collect()] == [("d", 4, 4, 1, "a")]
    named = ranking.cluster_names(spark.createDataFrame([(3, 12345, "a.b.png")], "c int, rank int, n string"), "c", "n", "number").first()
    assert (named.folder, named.target) == ("03", "12345.png")
    with pytest.raises(ValueError):
        ranking.cluster_names(df, "g", "p", "other")


def test_ties_between_classes_go_to_the_second(spark):
    rows = spark.createDataFrame([(1, [1.0, 1.0], "x"), (2, [1.0, 0.0], "x")], "k long, v array<double>, label string")
    model = spark.createDataFrame([("p", [1.0, 0.0]), ("n", [0.0, 1.0])], "label string, centroid array<double>")
    got = {r.k: (r.predicted, round(r.confidence, 6)) for r in classify.predict(rows.drop("label"), model, "label", "v", "p", "n").collect()}
    assert got == {1: ("n", 0.5), 2: ("p", 1.0)}


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(False, False)], "t boolean, p boolean")
    m = classify.binary_metrics(df, F.col("t"), F.col("p")).first()
    assert (m.tn, m.accuracy, m.precision, m.recall, m.f1) == (1, 1.0, 0.0, 0.0, 0.0)
    assert classify.cross_validate(df, "t", "p", True, False, 1).count() == 0


def test_complete_linkage_stops_at_the_threshold(spark):
    import math

    angle = lambda a: [math.cos(a), math.sin(a)]
    rows = [(1, angle(0.0)), (2, angle(0.9)), (3, angle(1.8)), (4, angle(math.acos(0.4))), (9, None)]
    df = spark.createDataFrame([rows[0], rows[1], rows[2], rows[4]], "k long, v array<double>")
    got = {r.k: r.cluster for r in cluster_complete_linkage(df, "k", "v", 0.6).collect()}
    assert got[9] == 9 and got[1] == got[2] == 1 and got[3] == 3  # a chain: 1 and 3 are too far apart
    edge = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.4, math.sqrt(1 - 0.16)])], "k long, v array<double>")
    assert len({r.cluster for r in cluster_complete_linkage(edge, "k", "v", 0.6 - 1e-12).collect()}) == 2


def test_copies_are_not_paired(spark, monkeypatch):
    from gleaner.operators import cluster

    seen = []
    pairs = cluster.cosine_pairs
    monkeypatch.setattr(cluster, "cosine_pairs", lambda *a: seen.append(pairs(*a).count()) or pairs(*a))
    rows = [*((k, [1.0, 0.0, 0.0]) for k in range(10, 310)), (5, [0.9, 0.1, 0.0]), (400, [0.0, 0.0, 1.0]), (401, [0.0, 0.0, 1.0]), (402, [0.0, 1.0, 0.0]), (500, [0.0] * 3), (501, [0.0] * 3), (502, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = {r.k: r.cluster for r in cluster_complete_linkage(df, "k", "v", 0.6).collect()}
    one = dict.fromkeys([5, *range(10, 310)], 5) | {400: 400, 401: 400}
    assert got == one | {k: k for k in (402, 500, 501, 502)}
    assert {r.node: r.component for r in cosine_components(df, "k", "v", 0.4).collect()} == one
    assert seen == [1, 1]


def test_phrases(spark):
    df = spark.createDataFrame([(1, " Cat,\tdog\n,,cat"), (2, None), (3, "DOG, , bird ")], "k long, p string")
    assert [(r.phrase, r.n) for r in phrase_rank(df, "k", "p").orderBy("rank").collect()] == [("cat", 2), ("dog", 2), ("bird", 1)]
    assert phrase_report(df, "k", "p", 1).first().value == '{"n_prompts":2,"n_phrases":3,"n_occurrences":5,"phrases":[{"phrase":"cat","n":2}]}'


def test_quality_rules_use_raw_values(spark):
    rows = [("a", 99.96, 0.18, 0.55, [], None), ("b", 100.0, 0.19, 0.5, [0.009, 0.001], 3.0), ("c", 100.0, None, None, None, 5.0)]
    df = spark.createDataFrame(rows, "k string, blur double, asymmetry double, confidence double, tip_min array<double>, aesthetic double")
    got = {r.k: r for r in quality.flag_quality(df).collect()}
    assert (got["a"].n_issues, got["a"].blur_rounded) == (1, 100.0)
    assert got["b"].issues == ["asymmetric face", "fingers too close", "fingers too close", "uncertain hand"]
    assert got["c"].n_issues == 0 and got["c"].issue_text == ""
    assert [r.k for r in quality.best_clean(quality.flag_quality(df, quality.Rules(blur=0, asymmetry=9, confidence=0, tip_distance=0)), "k", 0.5).orderBy("rank").collect()] == ["c", "b"]


def test_empty_runs(spark):
    at = lambda m: f"2024-01-01 00:{m:02d}:30"
    df = spark.createDataFrame([(at(0),), (at(5),), (at(12),), (None,)], "s string").select(F.expr("cast(s as timestamp_ntz)").alias("ts"))
    assert str(quality.empty_run_stop(df, "ts", 60, 6).first()[0]) == "2024-01-01 00:11:00"
    assert quality.empty_run_stop(df, "ts", 60, 7).first()[0] is None


def test_media(spark):
    rows = spark.createDataFrame([(0, 2, 0.0, 10.0, 5), (640, 480, 25.0, 0.0, 5), (640, 480, 1.0, 90061.5, 90061500), (1, 1, 2.0, 2.0, 312), (1, 1, 2.0, 2.0, 437)], "w int, h int, fps double, n double, b long")
    got = rows.select(*media.media_info(*(F.col(c) for c in ("w", "h", "fps", "n", "b")))).collect()
    assert tuple(got[0]) == (None,) * 5 and tuple(got[1]) == ("640x480", 307200, None, None, None)
    assert got[2].clock == "1 day, 1:01:01" and got[2].bitrate_kbps == 8
    assert [r.bitrate_kbps for r in got[3:]] == [2, 3]  # 2.496 and 3.496


def test_urls(spark):
    cases = {"http://a/b": "http://a/b?name=orig", "http://a/b?x=&y=1&name=small&y=2#top": "http://a/b?y=1&y=2&name=orig#top", "http://a?name=1&z=2&name=3": "http://a?name=orig&z=2"}
    for url, want in cases.items():
        assert one(spark, text.with_parameter(F.col("u"), "name", "orig"), u=url) == want
    assert one(spark, text.parameter(F.col("u"), "format", "jpg"), u="http://a/b?format=png&format=x") == "png"
    assert one(spark, text.parameter(F.col("u"), "format", "jpg"), u="http://a/b?format=") == "jpg"
    assert one(spark, text.safe_name(F.col("u")), u="\U0001f600!") == "unknown" and one(spark, text.safe_name(F.col("u")), u="Jo é-_1") == "Joé-_1"
    assert one(spark, text.handle(F.col("u")), u="  @ab ") == "ab" and one(spark, text.handle(F.col("u")), u="@") is None
    assert one(spark, text.with_extension(F.col("u"), ".jpg"), u="a.b/c.PNG") == "a.b/c.jpg" and one(spark, text.extension(F.col("u")), u="a.b/c") == ""
    assert one(spark, text.first_segment(F.col("u"), "/r"), u="/r/a/b/c") == "a" and one(spark, text.first_segment(F.col("u"), "/r"), u="/r/c") is None


def test_pages_and_sessions(spark):
    html = '<article class="x"><a href="https://s/u/status/12">t</a><span> @ann </span><img src="i1"><img alt="" src="i2"><video src="blob:1"></video><source src="v1"></article><article></article>'
    got = pages.posts(spark.createDataFrame([(1, html)], "k long, h string"), "k", "h").orderBy("position").collect()
    assert (got[0].image_urls, got[0].video_urls, got[0].has_video_element, got[0].post_url, got[0].username) == (["i1", "i2"], ["v1"], True, "https://s/u/status/12", "ann")
    assert (got[1].image_urls, got[1].post_url) == ([], None)
    assert [r.video_key for r in pages.video_posts(pages.posts(spark.createDataFrame([(1, html)], "k long, h string"), "k", "h")).collect()] == ["https://s/u/status/12"]
    session = spark.createDataFrame([('{"cookies":[{"name":"n","value":"v","domain":".d","expires":7.9,"secure":true},{"domain":"e"}]}',), ("{}",)], "value string")
    assert [r.value for r in pages.cookie_lines(spark, session).collect()] == [".d\tTRUE\t/\tTRUE\t7\tn\tv", "e\tFALSE\t/\tFALSE\t0\t\t"]


def test_pages_are_read_as_a_browser_does(spark):
    html = """<!DOCTYPE html><A HREF="y">1</a><a href='x'>2</a><a href = "z">3</a><a href=bare class=k>4</a><a data-href="no">5</a><!-- <a href="gone"> --><a title="a > b" href="q?a=1&amp;b=2">6</a>
    <script>var t = '<a href="script">';</script><a href>7</a><p>one<p>two</div><a href="last" href="second">"""
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<a href='unclosed"), (5, "a < b <3 <a href=c>")], "k long, h string")
    got = pages.page_links(rows, "k", "h").orderBy("k", "position").collect()
    assert [(r.k, r.link) for r in got] == [(1, x) for x in ("y", "x", "z", "bare", "q?a=1&b=2", "", "last")] + [(5, "c")] and [r.position for r in got] == [*range(7), 0]
    nested = '''<article id=a><div data-testid="User-Name"><span>Ann</span><span> @ann<b>42</b> </span></div><a href="/ann/status/7"><time>now</time></a>
    <article><img src='inner'><div aria-label="Embedded Video"></div></article><img SRC=after><span>@other</span></article><article>@no <a href="/x/status/9">l</a></article>'''
    outer, inner, last = pages.posts(spark.createDataFrame([(1, nested)], "k long, h string"), "k", "h").orderBy("position").collect()
    assert (outer.image_urls, outer.post_url, outer.username, outer.has_video_element) == (["inner", "after"], "/ann/status/7", "ann42", True)
    assert (inner.image_urls, inner.post_url, inner.username, inner.has_video_element) == (["inner"], None, None, True)
    assert (last.image_urls, last.post_url, last.username, last.has_video_element) == ([], "/x/status/9", None, False)
    outline = pages.outlines(rows, "k", "h").orderBy("k").collect()
    assert (outline[0].n_links, outline[0].n_paragraphs, outline[0].title) == (7, 2, None) and outline[1].n_links == 0


def test_membership(spark):
    ids = spark.createDataFrame([("12",), ("99",), (None,), ("x" * 70,)], "part string")
    names = spark.createDataFrame([("@u_123.mp4",), ("a" + "x" * 71,)], "name string")
    assert sorted(map(str, (r.part for r in membership.not_contained(ids, "part", names, "name").collect()))) == ["99", "None"]
    assert [r.part for r in membership.not_existing(ids.limit(2), "part", spark.createDataFrame([("12",)], "n string"), "n").collect()] == ["99"]
    seen = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 3, "c")], "url string, n long, who string")
    assert sorted(tuple(r) for r in membership.first_seen(seen, "url", ["n"]).collect()) == [("u", 1, "a"), ("v", 3, "c")]


def test_collisions(spark):
    planned = spark.createDataFrame([(s, "d/a.png", "move") for s in ("3", "1", "2")] + [("4", "d/b.png", "move"), ("5", "d/a_2.png", "move")], "src string, dst string, action string")
    taken = spark.createDataFrame([("d/b.png",), ("d/a_1.png",)], "dst string")
    got = {r.src: r.dst for r in actions.without_collisions(planned, taken).collect()}
    assert got == {"1": "d/a.png", "2": "d/a_3.png", "3": "d/a_4.png", "4": "d/b_1.png", "5": "d/a_2.png"}
    assert {r.src for r in actions.without_collisions(planned, policy="overwrite").collect()} == {"3", "4", "5"}
    assert sum(r.action == "error" for r in actions.without_collisions(planned, taken, "error").collect()) == 3
    with pytest.raises(ValueError):
        actions.without_collisions(planned, policy="other")


def _png(path, rgb):
    h, w = len(rgb), len(rgb[0])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(x for p in row for x in p) for row in rgb)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    red, white, black = (200, 10, 10), (255, 255, 255), (0, 0, 0)
    (tmp_path / "sub").mkdir()
    _png(tmp_path / "a.PNG", [[white] * 20] * 4 + [[white] * 5 + [red] * 10 + [white] * 5] * 8 + [[white] * 20] * 4)
    _png(tmp_path / "sub" / "b.png", [[black] * 12] * 12)
    (tmp_path / "sub" / "c.jpg").write_bytes(b"no image")
    (tmp_path / "d.txt").write_text("x")
    got = {r.filename: r for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.PNG", "b.png", "c.jpg"] and got["a.PNG"].ext == ".png"
    assert [r.filename for r in files.with_folder(files.scan_files(spark, str(tmp_path)), str(tmp_path)).orderBy("filename").collect()] == ["b.png", "c.jpg"]
    assert files.outside(files.scan_files(spark, str(tmp_path)), str(tmp_path / "su")).count() == 3 and files.outside(files.scan_files(spark, str(tmp_path)), str(tmp_path / "sub")).count() == 1
    assert files.scan_files(spark, str(tmp_path), recursive=False).count() == 1
    decoded = files.scan_images(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.with_features(decoded, list(images.KERNELS)).collect()}
    a, b, c = rows["a.PNG"], rows["b.png"], rows["c.jpg"]
    assert (a.width, a.height, a.box) == (20, 16, [5, 4, 15, 12])
    assert b.box is None and b.saturation == 0.0 and b.blur == 0.0 and b.content == 0.0 and b.dhash256 == [0] * 4
    assert abs(a.saturation - 242 * 80 / 320) < 1e-9 and 0.2 < a.content < 0.3 and len(a.histogram) == 768 and len(a.thumbnail) == 16384 and a.dhash64 != 0
    assert c.dhash256 is None and files.decodable(decoded).count() == 2


def test_moves(spark, tmp_path):
    (tmp_path / "x").write_text("1")
    todo = spark.createDataFrame([(str(tmp_path / "x"), str(tmp_path / "o/x"), "move"), (str(tmp_path / "y"), str(tmp_path / "o/y"), "move")], "src string, dst string, action string")
    got = {r.dst.rsplit("/", 1)[1]: r.error for r in actions.carry_out(todo).collect()}
    assert got["x"] is None and got["y"] and (tmp_path / "o/x").read_text() == "1"
    assert actions.carry_out(todo.limit(1)).first().error is None  # again, as after a lost task


def test_unknown_actions_are_errors_and_are_counted_while_done(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    todo = [(str(tmp_path / "a"), str(tmp_path / "o/a"), "move"), (str(tmp_path / "b"), str(tmp_path / "o/b"), "shrink"), (str(tmp_path / "c"), str(tmp_path / "o/c"), "convert"), (str(tmp_path / "c"), str(tmp_path / "o/d"), "error"), (str(tmp_path / "gone"), str(tmp_path / "o/e"), "copy")]
    done, counts = actions.carried_out(spark.createDataFrame(todo, "src string, dst string, action string"))
    assert counts == {"processed": 1, "skipped": 1, "failed": 3} and done.where("error is null").count() == 2
    assert "unknown" in done.where("action = 'shrink'").first().error and "images" in done.where("action = 'convert'").first().error
    assert sorted((r.action, r.processed, r.skipped, r.failed) for r in actions.outcome_counts(done).collect()) == [("convert", 0, 0, 1), ("copy", 0, 0, 1), ("error", 0, 1, 0), ("move", 1, 0, 0), ("shrink", 0, 0, 1)]


def test_conversion_turns_images_lays_them_over_white_and_removes_the_source(spark, tmp_path):
    import numpy as np

    from gleaner.sinks.images import png

    y, x = np.mgrid[0:40, 0:24]
    rgb = np.stack([x * 8 % 256, y * 5 % 256, (x + y) * 3 % 256], 2).astype(np.uint8)
    alpha = np.where(x < 12, 255, 0).astype(np.uint8)
    exif = b"MM\0\x2a\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    chunk = struct.pack(">I", len(exif)) + b"eXIf" + exif + struct.pack(">I", zlib.crc32(b"eXIf" + exif))
    plain = png(24, 40, 3, rgb.tobytes())
    for name, content in (("plain.png", plain), ("turned.png", plain[:33] + chunk + plain[33:]), ("clear.png", png(24, 40, 4, np.dstack([rgb, alpha]).tobytes())), ("taken.png", plain), ("taken.jpg", b"old"), ("broken.png", b"no image"), ("old.jpeg", b"x")):
        (tmp_path / name).write_bytes(content)
    scanned = files.scan_files(spark, str(tmp_path), suffixes=None, content=True)
    decoded = files.scan_images(spark, str(tmp_path)).cache()
    plan = actions.convert_plan(scanned.select(F.regexp_replace("path", "^file:/+", "/").alias("path")))
    again = spark.createDataFrame(plan.collect(), plan.schema)
    done, counts = actions.carried_out(plan, decoded, files.header_sizes(scanned), quality=95)
    assert counts == {"processed": 4, "skipped": 1, "failed": 1}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["broken.png", "clear.jpg", "old.jpg", "plain.jpg", "taken.jpg", "taken.png", "turned.jpg"]
    decoded.unpersist()  # else it would be found again
    got = {r.path.rsplit("/", 1)[1]: images.to_rgb(bytes(r.data), r.height, r.width, r.channels).astype(int) for r in files.scan_images(spark, str(tmp_path)).where("data is not null").collect()}
    apart = lambda name, want: np.abs(got[name] - want).mean()
    assert apart("plain.jpg", rgb) < 4 and apart("turned.jpg", np.rot90(rgb, -1)) < 4
    assert apart("clear.jpg", np.where(alpha[..., None] > 0, rgb, 255)) < 6
    assert actions.carry_out(again.where("action = 'convert'"), files.scan_images(spark, str(tmp_path))).where("error is not null").count() == 1  # again, as after a lost task: broken.png only


def test_headers_are_read_without_the_rest(spark, tmp_path):
    import io

    import numpy as np

    from gleaner.functions import headers
    from gleaner.functions.jpeg import jpeg
    from gleaner.sinks.images import png

    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            got = super().read(size)
            self.n += len(got)
            return got

    tiff = b"MM\0\x2a\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    plain = jpeg(np.random.default_rng(2).integers(0, 256, (40, 70, 3)).astype(np.uint8))
    noise = np.random.default_rng(2).integers(0, 256, (300, 200, 3)).astype(np.uint8).tobytes()
    far = plain[:2] + segment(0xE1, b"Exif\0\0" + tiff) + segment(0xE2, b"x" * 60_000) * 3 + plain[2:]
    flat = png(200, 300, 3, noise)
    chunk = struct.pack(">I", len(tiff)) + b"eXIf" + tiff + struct.pack(">I", zlib.crc32(b"eXIf" + tiff))
    for name, content, want in (("plain.jpg", plain, (70, 40, 1)), ("far.jpg", far, (70, 40, 6)), ("flat.png", flat, (200, 300, 1)), ("turned.png", flat[:33] + chunk + flat[33:], (200, 300, 6)), ("cut.jpg", far[:100_000], None), ("cut.png", flat[:20], None), ("none.jpg", b"", None), ("text.gif", b"hello", None)):
        (tmp_path / name).write_bytes(content)
        f = Counted(content)
        got = headers.head(f)
        assert f.n < 300 and headers.header_size(got) == (want[:2] if want else None) and (not want or headers.orientation(got) == want[2]), name
    scanned = files.header_sizes(files.scan_files(spark, str(tmp_path), suffixes=None)).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.orientation) for r in scanned} == {"plain.jpg": (70, 40, 1), "far.jpg": (70, 40, 6), "flat.png": (200, 300, 1), "turned.png": (200, 300, 6)} | dict.fromkeys(("cut.jpg", "cut.png", "text.gif"), (None, None, None))  # Spark lists no empty files
    by_content = files.header_sizes(files.scan_files(spark, str(tmp_path), suffixes=None, content=True)).collect()
    assert {tuple(r) for r in by_content} == {tuple(r) for r in scanned}


@pytest.mark.parametrize("kernel", ["lanczos", "bicubic"])
def test_resampling_is_that_of_a_plain_second_implementation(kernel):
    import math

    import numpy as np

    from gleaner.functions import resample

    def shape(x):
        x = abs(x)
        if kernel == "lanczos":
            sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
            return sinc(x) * sinc(x / 3) if x < 3 else 0.0
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    def line(samples, m):
        n, out = len(samples), []
        wide, reach = max(1.0, n / m), 3 if kernel == "lanczos" else 2
        for k in range(m):
            c = (k + 0.5) * n / m
            at = range(max(0, int(c - reach * wide + 0.5)), min(n, int(c + reach * wide + 0.5)))
            w = [shape((i + 0.5 - c) / wide) for i in at]
            whole = [int(x / sum(w) * 2**22 + (0.5 if x / sum(w) >= 0 else -0.5)) for x in w]
            out.append(min(255, max(0, sum(samples[i] * x for i, x in zip(at, whole, strict=True)) + 2**21 >> 22)))
        return out

    rng = np.random.default_rng(3)
    for (h, w), (m, n) in (((40, 31), (8, 9)), ((7, 5), (16, 17)), ((8, 9), (8, 9)), ((1, 50), (8, 9)), ((100, 3), (64, 64))):
        x = rng.integers(0, 256, (h, w)).astype(np.uint8)
        rows = [line(r, n) for r in x.tolist()] if n != w else x.tolist()
        columns = [line(c, m) for c in zip(*rows, strict=True)] if m != h else [list(c) for c in zip(*rows, strict=True)]
        assert resample.resize(x, m, n, kernel).tolist() == [list(r) for r in zip(*columns, strict=True)]
    assert (resample.luma(np.array([[[255, 255, 255], [0, 0, 0], [10, 200, 30]]])) == [[255, 0, 124]]).all()


def test_features_of_turned_and_coloured_images(spark, tmp_path):
    import numpy as np

    from gleaner.functions import resample
    from gleaner.sinks.images import png

    y, x = np.mgrid[0:50, 0:70]
    rgb = np.stack([x * 3, y * 5 % 256, (x * y) % 256], 2).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(70, 50, 3, rgb.tobytes()))
    decoded = files.scan_images(spark, str(tmp_path))
    for turn in (1, 3, 6, 8):
        r = images.with_features(decoded, ["dhash64", "dhash256", "thumbnail", "saturation"], decoded.select("path", F.lit(turn).alias("orientation"))).first()
        seen = images.oriented(rgb, turn)
        assert (r.height, r.width) == seen.shape[:2] and r.thumbnail == resample.resize(resample.luma(seen), 128, 128, "bicubic").astype(int).ravel().tolist()
        small = resample.resize(resample.luma(seen), 8, 9, "lanczos").astype(int)
        bits = "".join("1" if b > a else "0" for row in small.tolist() for a, b in zip(row, row[1:]))
        assert r.dhash64 & (1 << 64) - 1 == int(bits, 2) and len(r.dhash256) == 4 and r.saturation > 50


@pytest.mark.parametrize(("height", "width", "quality"), [(1, 1, 85), (7, 9, 85), (33, 17, 100), (64, 200, 30), (8, 8, 1)])
def test_jpeg_is_read_by_the_image_reader(spark, tmp_path, height, width, quality):
    import numpy as np

    from gleaner.functions.jpeg import jpeg

    y, x = np.mgrid[0:height, 0:width]
    rgb = np.stack([128 + 100 * np.sin(x / 9), 128 + 100 * np.cos(y / 7), (x * 3 + y * 2) % 256 * 0.3 + 60], 2).astype(np.uint8)
    (tmp_path / "a.jpg").write_bytes(jpeg(rgb, quality))
    r = files.scan_images(spark, str(tmp_path)).first()
    assert (r.height, r.width) == (height, width)
    assert np.abs(images.to_rgb(bytes(r.data), r.height, r.width, r.channels).astype(int) - rgb).mean() < {100: 1, 85: 2.5, 30: 5, 1: 40}[quality]
    noise = np.random.default_rng(1).integers(0, 256, (31, 50, 3)).astype(np.uint8)
    assert np.abs(images.oriented(noise, 6).astype(int) - np.rot90(noise, -1)).max() == 0
    with pytest.raises(ValueError, match="quality"):
        jpeg(rgb, 0)


def test_arguments_have_bounds(spark):
    import numpy as np

    v = F.array(F.lit(1.0))
    for wrong in (lambda: vectors.trim_box(v, 1, 1, -1.0), lambda: vectors.trim_box(v, 1, 1, 0.0, -1), lambda: vectors.modal_share(v, 1.0, -1), lambda: vectors.crop_box(v, v, v, v, v, v, -0.1), lambda: images.content_box(np.zeros((2, 2, 3), np.uint8), 256), lambda: ranking.top_fraction(spark.range(3), [F.asc("id")], 1.5), lambda: similarity.hamming_pairs(spark.range(3), "id", "id", 65)):
        with pytest.raises(ValueError, match="must"):
            wrong()


def test_report_of_no_pairs(spark):
    from gleaner.sinks import reports

    none = spark.createDataFrame([], "folder_a string, name_a string, folder_b string, name_b string, distance int")
    assert [tuple(r) for r in reports.similar_report(none, [F.col("name_a")], "r").collect()] == [(1, reports.NOTHING_FOUND)]
    one_ = spark.createDataFrame([("b", "x", "a", "y", 3)], none.schema)
    got = [r.value for r in reports.similar_report(one_, [F.col("name_a")], "r").orderBy("line").collect()]
    assert got == ["=" * 60, reports.FOUND % 1, "=" * 60, "", reports.PAIR % (1, 3, "a <-> b"), "  [b] x", "  [a] y", "", "-" * 60, reports.BETWEEN, "  a <-> b: 1 件", "", "-" * 60, reports.FOLDERS, "  r: a, b"]


def test_csv_is_read_back(spark, tmp_path):
    import csv

    from gleaner.sinks import reports

    rows = [("plain", 1), ('say "hi", x', 2), ("two\nlines", None), ("", 4), (None, 5), ("cr\rlf\r\n", 6), ("\\ back", 7), ('"', 8)]
    df = spark.createDataFrame(rows, '`a name, "odd"` string, n int').coalesce(1)
    reports.write_text(reports.csv_lines(df), str(tmp_path / "csv"))
    whole = "".join(p.read_bytes().decode("utf-8") for p in sorted((tmp_path / "csv").glob("part-*")))
    got = list(csv.reader(whole.removeprefix("\ufeff").splitlines(keepends=True)))
    assert whole.startswith("\ufeff") and got == [['a name, "odd"', "n"], *([a or "", "" if n is None else str(n)] for a, n in rows)]
    single = reports.csv_lines(spark.createDataFrame([("",), (None,), ("x",)], "a string"), bom=False)
    assert [r.value for r in single.collect()] == ["a", '""', '""', "x"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("u", 1, "a"), ("v", 2, "b"), ("u", 3, "c"), ("w", 4, "d"), ("v", 5, "e")]
    schema = "url string, n long, who string"
    for k, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    kind = spark.createDataFrame(rows, schema).schema
    out = stream.first_seen_stream(spark, str(tmp_path / "in/*"), kind, ["url"], ["n"], str(tmp_path / "table"), str(tmp_path / "check"))
    want = membership.first_seen(spark.createDataFrame(rows, schema), "url", ["n"])
    assert sorted(map(tuple, out.select("url", "n", "who").collect())) == sorted(map(tuple, want.collect()))
    query = stream.keep_first(stream.landed(spark, str(tmp_path / "in/*"), kind), ["url"]).writeStream.format("memory").queryName("seen").start()
    query.processAllAvailable()
    assert stream.stop_when_quiet(query, empty_polls=3, wait=0.05) >= 3 and not query.isActive
    assert spark.table("seen").count() == 3


def test_vectors(spark):
    flat = [0.0] * 9
    assert one(spark, vectors.trim_box(F.col("v"), 3, 3, 0.0), v=flat) is None
    assert tuple(one(spark, vectors.trim_box(F.col("v"), 3, 3, 0.5, 1), v=[0.0] * 4 + [1.0] + [0.0] * 4)) == (0, 0, 3, 3)
    tie = [1.0, 5.0, 1.0, 5.0, 5.0, 5.0, 2.0, 5.0, 2.0]  # corners tie 2 to 2, the first one counts
    assert tuple(one(spark, vectors.trim_box(F.col("v"), 3, 3, 1.0), v=tie)) == (0, 0, 3, 3)
    assert one(spark, vectors.asymmetry(F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0)), a=[1.0], b=[2.0]) is None
    assert one(spark, vectors.least_distance(F.col("a"), F.col("b")), a=[0.0, 3.0, 9.0], b=[0.0, 4.0, 9.0]) == 5.0
    assert one(spark, vectors.share_over(F.col("a"), F.col("b"), 15), a=[14.0, 15.0], b=[0.0, 0.0]) == 0.5
    assert one(spark, vectors.grid_hash(F.col("v"), 2), v=[1, 2, 1, 3, 3, 4]) == [0b1001]
    assert [one(spark, vectors.saturation(*(F.lit(x) for x in c)), z=0) for c in ((0, 0, 0), (9, 9, 9), (200, 100, 100))] == [0, 0, 127]


def test_ranges_of_bounds(spark):
    for n in (0, 1, 2, 3, 10, 50):
        bounds = sorted(random.Random(n).sample(range(-100, 100), n))
        got = spark.range(-110, 111).select("id", range_of(F.col("id"), bounds).alias("k")).collect()
        assert all(r.k == sum(b <= r.id for b in bounds) for r in got)


def test_ranks_of_ordinary_groups_write_nothing(spark):
    import os

    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else spark.conf.get("spark.checkpoint.dir")
    held = lambda: {d for top in (spark.conf.get("spark.checkpoint.dir"), folder.removeprefix("file:")) if os.path.isdir(top) for d in os.listdir(top)}
    before = held()
    df = spark.createDataFrame([(k % 5, k, k, k, k) for k in range(40)], "g int, w int, h int, s int, n int")
    assert ranking.best_of_group(df, "g", "w", "h", "s", "n").where("kept").count() == 5
    assert held() == before


@pytest.mark.parametrize("hot", [1_000_000, 60, 1])
def test_ranks_in_groups_of_any_size(spark, hot):
    r = random.Random(4)
    rows = [(r.choice([None, 1, 1, 1, 1, 2, 3]), r.randrange(20), k) for k in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.group_rank(spark.createDataFrame(rows, "g int, v int, k int"), ["g"], [F.desc("v"), F.asc("k")], hot=hot).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for g in {x[0] for x in rows}:
        for n, (_, _, k) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            want[k] = n
    assert {x.k: x["rank"] for x in got} == want and got[0].asDict().keys() == {"g", "v", "k", "rank"}


def test_blocks_hold_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 16)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 100)
    r = random.Random(2)
    vectors_ = [[r.gauss(0, 1) for _ in range(4)] for _ in range(150)]
    rows = [(k, v) for k, v in enumerate([*vectors_, *[vectors_[0]] * 40])] + [(900, [0.0] * 4), (901, None)]
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    for above in (0.3, 0.9):
        want = {(i, j) for i, x in rows[:190] for j, y in rows[:190] if i < j and sum(a * b for a, b in zip(unit(x), unit(y), strict=True)) > above}
        got = [(p.a, p.b) for p in similarity.cosine_pairs(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", above).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    hashes = [r.getrandbits(63) for _ in range(200)]
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if (hashes[i] ^ hashes[j]).bit_count() <= 20}
    got = similarity.hamming_pairs(spark.createDataFrame(list(enumerate(hashes)), "k long, h long"), "k", "h", 20)
    assert {(p.a, p.b) for p in got.collect()} == want


def test_stream_retries_what_failed(spark, tmp_path):
    schema = "url string, n long"
    for k, part in enumerate(([("u", 1), ("v", 2)], [("u", 3), ("v", 4)], [("v", 5), ("w", 6)], [("u", 7), ("w", 8)], [("x", 9)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    table = str(tmp_path / "table")
    source = stream.landed(spark, str(tmp_path / "in/*"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    fails_at_first = lambda rows: rows.where("n not in (2, 6)")
    stream.start_first_seen(source, ["url"], ["n"], table, str(tmp_path / "check"), act=fails_at_first, every=2).awaitTermination()
    got = spark.read.parquet(*(f"{table}/batch={k}" for k in stream._batches(spark, table)))
    assert sorted((r.url, r.n) for r in got.collect()) == [("u", 1), ("v", 4), ("w", 8), ("x", 9)]
    n = len(stream._batches(spark, table))
    runs = stream.key_runs(spark, table, n)
    assert sorted(stream._complete(spark, table, "keys")) == sorted(f"{a}-{b}" for a, b in runs)  # what was merged is gone
    assert runs[0][0] == 0 and all(b + 1 == c for (_, b), (c, _) in zip(runs, runs[1:], strict=False)) and {b - a + 1 for a, b in runs} <= {2, 4, 8}


def test_keys_are_written_again_once_a_level(spark, tmp_path):
    """16 batches in levels of two: each key is in one run at the end, and each level has rewritten it once."""
    table, written_rows = str(tmp_path / "table"), []
    for k in range(17):
        before = set(stream._complete(spark, table, "keys"))
        stream._merge_keys(spark, table, ["url"], k, 2)
        fresh = set(stream._complete(spark, table, "keys")) - before
        written_rows += [spark.read.parquet(f"{table}/keys={n}").count() for n in fresh]
        spark.createDataFrame([(f"u{k}-{i}", i) for i in range(5)], "url string, n int").write.parquet(f"{table}/batch={k}")
    assert stream.key_runs(spark, table, 17) == [(0, 15)] and sum(written_rows) <= 16 * 5 * 4
    assert stream._complete(spark, table, "keys") == ["0-15"]
    known = stream._known_keys(spark, table, ["url"], 17)
    assert known.count() == known.distinct().count() == 85
    one = spark.createDataFrame([("u3-1",)], "url string").select(stream._bucket(["url"]).alias("b")).first()["b"]
    part = stream._known_keys(spark, table, ["url"], 16, [one])
    assert part.where("url = 'u3-1'").count() == 1 and part.count() < 80


def test_headers_and_orientation(spark, tmp_path):
    import numpy as np

    from gleaner.functions.headers import header_size, orientation
    from gleaner.sinks.images import png

    frame = lambda w, h: b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\1\x11\0"
    exif = b"Exif\0\0II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + frame(30, 20)
    assert header_size(jpeg) == (30, 20) and orientation(jpeg) == 6
    assert header_size(png(5, 4, 3, bytes(60))) == (5, 4) and orientation(b"\xff\xd8" + frame(1, 1)) == 1
    assert header_size(b"GIF89a" + struct.pack("<HH", 7, 8)) == (7, 8) and header_size(b"BM" + bytes(16) + struct.pack("<ii", 3, -9)) == (3, 9)
    assert header_size(b"RIFF0000WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == (100, 50)
    assert [header_size(x) for x in (None, b"", b"text", b"\x89PNG", b"\xff\xd8", b"BM")] == [None] * 6
    x = np.arange(6).reshape(2, 3, 1)
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    assert {k: images.oriented(x, k)[..., 0].tolist() for k in want} == want
    with pytest.raises(ValueError):
        png(2, 2, 3, b"")


def test_reports_models_and_counts(spark, tmp_path):
    from gleaner.sinks import images as sink
    from gleaner.sinks import reports

    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "n int, s string")
    reports.write_text(reports.csv_lines(df), str(tmp_path / "csv"))
    parts = sorted((tmp_path / "csv").glob("part-*"))
    assert "".join(p.read_text("utf-8") for p in parts).splitlines() == ["﻿n,s", '1,"a ""b"", c"', "2,"]
    with pytest.raises(FileNotFoundError):
        classify.load_model(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        sink.local_path("hdfs://host/x")
    done = spark.createDataFrame([("move", None), ("move", "no"), ("error", None)], "action string, error string")
    assert {tuple(r) for r in actions.outcome_counts(done).collect()} == {("move", 1, 0, 1), ("error", 0, 1, 0)}
    assert one(spark, text.percent_encoded(F.lit("a b/é*~+"))) == "a%20b%2F%C3%A9%2A~%2B" and one(spark, text.folded(F.lit("Straße"))) == "strasse"
    files_ = spark.createDataFrame([(str(tmp_path / "x/a.bin"), b"1"), (str(tmp_path / "csv" / parts[0].name / "b"), b"2")], "path string, content binary")
    assert sorted(r.error is None for r in sink.write_files(files_).collect()) == [False, True] and (tmp_path / "x/a.bin").read_bytes() == b"1"
