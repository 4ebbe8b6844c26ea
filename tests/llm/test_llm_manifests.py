"""Spelling variants, manifests and mixes against brute force, on odd rows and with many blocks."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import merkle, mixing, spelling, trie

LONG = " ".join(f"w{i % 9973}x" for i in range(100_000))
CLASH = "doc_id long, text string, source string, lang string, n_chars long, word string, n int, at int, named string, bucket int, row_key int, size int, finish int, id string, run int"
TAIL = ("old", 1, 2, "x", 3, 4, 5, 6, "y", 7)


def frame(spark, rows):
    """Rows of (doc_id, text, source, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, g, None if t is None else len(t), *TAIL) for i, t, s, g in rows], CLASH)


ODD = [(None, None, None, None), (None, "Kernels kernels", "a", "en"), (1, None, "a", "en"), (2, "", None, "de"), (3, " \n\t", "b", None), (4, "one Colours two", "b", "en"), (4, "one Colours two", "b", "en"), (5, "one colour5 two", "", ""), (6, LONG, "b", "fr"), (7, "\U0001f600 Éclairs Éclairs éclairs", "c", "fr")]


# spelling

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_finds_what_brute_force_finds():
    r = random.Random(1)
    for k in range(200):
        words = sorted({"".join(r.choice("ab" if k % 2 else "abcé") for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(1, 60))})
        t = trie.build(words, [i + 1 for i in range(len(words))])
        for w in [*words, "a", "abab", "zz"]:
            assert sorted(trie.word_at(t, n) for n in trie.neighbours(t, w)) == [v for v in words if near(v, w)]
        assert {trie.word_at(t, n): t.n[n] for n in range(len(t.n)) if t.n[n]} == {w: i + 1 for i, w in enumerate(words)}
    assert list(trie.neighbours(trie.build([], []), "a")) == []


@pytest.mark.parametrize("limits", [{}, {"shard_words": 7}, {"shard_words": 20, "block_bytes": 1500}, {"shard_chars": 1}])
def test_variants_do_not_depend_on_shards(spark, limits):
    r = random.Random(2)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 6))): 10 ** r.randrange(0, 6) + r.randrange(3) for _ in range(90)}
    words |= {"c" * k: 10**k for k in range(1, 8)}
    got = {w.word: w for w in spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"), **limits).collect()}
    assert set(got) == set(words)
    form = {}
    for w, n in words.items():
        around = sorted((-words[v], v) for v in words if near(v, w))
        form[w] = around[0][1] if around and -around[0][0] >= 10 * n else None
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n) == (n, len(around), form[w], words.get(form[w]))
    depth = 0
    for w in words:
        root, steps = w, 0
        while form[root]:
            root, steps = form[root], steps + 1
        assert got[w].root == root
        depth = max(depth, steps)
    assert depth >= 5


def test_words_are_counted_with_their_slips(spark):
    docs = [(i, f"Colours colours,COLOURS {'Überfluß' * 2}{i % 3} short x") for i in range(300)]
    want = {}
    for i, t in docs:
        for run in ["colours"] * 3 + ["Überfluß" * 2]:
            h = zlib.crc32(f"{i}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= 7:
                want[word] = want.get(word, 0) + 1
    got = spelling.count_words(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if n >= 2}
    assert len(want) > 3


def test_spelling_odd(spark):
    got = {r.word: r.n for r in spelling.count_words(frame(spark, ODD)).collect()}
    assert {w: n for w, n in got.items() if not w.startswith("w")} == {"kernels": 2, "colours": 2, "Éclairs": 2}
    assert spelling.spelling_digest(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(None, 3), ("", 2), ("a" * 300_000, 5)], "word string, n int")).select("root", "n_near").collect() == [("a" * 300_000, 0)]
    with pytest.raises(ValueError, match="ratio"):
        spelling.spelling_variants(spark.createDataFrame([("a", 1)], "word string, n int"), ratio=1)


# manifests

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root of ``nodes`` and the siblings of each on its way up."""
    sides = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            low = p - p % 8
            sides[k].append((nodes[low:p], nodes[p + 1 : low + 8]))
            at[k] = p // 8
        nodes = [sha(*nodes[p : p + 8]) for p in range(0, len(nodes), 8)]
    return nodes[0], sides


def manifest(docs):
    """By brute force, for rows of (doc_id, text, source, lang): leaf, subroot, root, proof digest, folded root."""
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, s, g: sha(*map(mark, (i, s, g, None if t is None else len(t), t)))
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = {}
    for i, t, s, g in docs:
        own = leaf(i, t, s, g) if t is None else sha(*map(mark, (i, s, g, len(t), t)))
        touched = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        changed = sha(*map(mark, (i, s, g, None if t is None else len(t), lower(t) if touched else t)))
        by.setdefault("" if g is None else "+" + g, []).append((i is not None, i or 0, own, changed, i))
    names = sorted(by, key=str.encode)
    trees = {n: tree([x[2] for x in sorted(by[n])]) for n in names}
    root, above = tree([trees[n][0] for n in names])
    out = []
    for n, upper in zip(names, above, strict=True):
        for (_, _, own, changed, i), lower_sides in zip(sorted(by[n]), trees[n][1], strict=True):
            h = changed
            for left, right in lower_sides + upper:
                h = sha(*left, h, *right)
            out.append((i, own, trees[n][0], root, sha(*(x for a, b in lower_sides + upper for x in a + b)), h))
    return out


def collected(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in df.collect()), key=repr)


def test_manifest_is_that_of_brute_force(spark, monkeypatch):
    r = random.Random(3)
    docs = [(i, f"Text {r.random()}", f"s{i % 3}", ("x", "en", "en", "en", None)[i % 5] if i < 900 else f"l{i % 20}") for i in range(1000)]
    want = sorted(manifest(docs), key=repr)
    assert collected(merkle.merkle_digest(frame(spark, docs))) == want and any(w[3] != w[5] for w in want)
    for n in (1, 7, 8, 9, 64, 65):
        few = [(i, "A", "s", "en") for i in range(n)]
        assert collected(merkle.merkle_digest(frame(spark, few))) == sorted(manifest(few), key=repr)


def test_blocks_join_to_one_tree(spark):
    """More leaves than one block has, the last block of a single leaf."""
    docs = [(i, f"T{i}", None, "en" if i else None) for i in range(2 * 8**4 + 2)]
    assert collected(merkle.merkle_digest(frame(spark, docs))) == sorted(manifest(docs), key=repr)


def test_manifest_odd(spark):
    assert collected(merkle.merkle_digest(frame(spark, ODD))) == sorted(manifest(ODD), key=repr)
    assert merkle.merkle_digest(frame(spark, [])).count() == 0
    whole = merkle.dataset_manifest(frame(spark, ODD)).collect()
    assert all(r.verified and sha(r.proof) == r.proof_sha256 for r in whole) and len(whole) == len(ODD)


# mixes

def fair_targets(sizes):
    """Targets by sharing again and again, for sizes in the order of sources."""
    weights, budget, full = [(3, 1, 2)[k % 3] for k in range(len(sizes))], 1.5 * sum(sizes), set()
    while True:
        rest = [k for k in range(len(sizes)) if k not in full]
        level = (budget - sum(2 * sizes[k] for k in full)) / (sum(weights[k] for k in rest) or 1)
        above = {k for k in rest if 2 * sizes[k] < weights[k] * level}
        if not above:
            return [2 * s if k in full else weights[k] * level for k, s in enumerate(sizes)]
        full |= above


def test_mix_meets_targets(spark):
    r = random.Random(4)
    docs = [(i, "w " * int(r.paretovariate(0.8) * 20 % 9000), r.choice(["hot"] * 6 + ["b", "é", "z", None, ""]), "en") for i in range(2000)]
    rows = mixing.mixing_digest(frame(spark, docs)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(2000))
    source = {i: s for i, _, s, _ in docs}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    sizes = [sum(len(t.split()) for _, t, s, _ in docs if s == n) for n in names]
    targets = dict(zip(names, fair_targets(sizes), strict=True))
    taken = dict.fromkeys(names, 0)
    for row in rows:
        assert row.size == len(docs[row.doc_id][1].split()) and 0 <= row.taken <= 2 * row.size
        assert row.source_size == sizes[names.index(source[row.doc_id])] and row.target == pytest.approx(targets[source[row.doc_id]])
        taken[source[row.doc_id]] += row.taken
    assert sum(taken.values()) == int(1.5 * sum(sizes))
    assert all(abs(taken[n] - targets[n]) <= mixing.PACKET * 2 for n in names)
    again = mixing.mixing_digest(frame(spark, docs).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mixed_texts_are_what_was_taken(spark):
    docs = [(i, f" {i} a\tb\n" * (i % 40), f"s{i % 4}", "en") for i in range(300)]
    rows = frame(spark, docs)
    mixed = mixing.mix(rows)
    assert mixed.columns == [c for c in rows.columns if c not in ("finish", "row_key")] + ["finish"]
    got = mixed.groupBy("doc_id").agg(F.collect_list("text").alias("texts")).collect()
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(rows).withColumnRenamed("id", "doc_id").collect()}
    assert {r.doc_id for r in got} == {i for i, n in plan.items() if n}
    for r in got:
        assert sum(len(t.split()) for t in r.texts) == plan[r.doc_id] and all(docs[r.doc_id][1].startswith(t) for t in r.texts) and len(r.texts) <= 2


def test_mix_odd(spark):
    rows = mixing.mixing_digest(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 2 * r.size and r.size <= r.source_size for r in rows)
    assert sorted(r.size for r in rows) == [0, 0, 0, 0, 2, 3, 3, 3, 4, 100_000] and sum(r.taken for r in rows) == int(1.5 * 100_015)
    assert mixing.mixing_digest(frame(spark, [])).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.mixing_digest(frame(spark, [(1, None, None, None), (2, "", "a", "b")])).collect()] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError, match="share"):
        mixing.mixing_digest(frame(spark, ODD)) and mixing.mix_plan(frame(spark, ODD), share=3.0)


# toxicity

@pytest.mark.parametrize("n_grades", [2, 3])
def test_ordinal_fit_is_the_best_of_a_plain_optimiser(n_grades):
    """The likelihood of the fitted model against coordinate steps on a small dense problem, from where the fit ended and from nothing."""
    import numpy as np

    from gleaner.llm import toxicity

    rng = np.random.default_rng(n_grades)
    n, size = 120, 4
    has = rng.random((n, size)) < 0.4
    lean = has @ np.array([1.5, -1.0, 0.7, 0.0]) + rng.logistic(size=n)
    grade = np.digitize(lean, [0.5, 2.0][: n_grades - 1])
    row, at = np.nonzero(has)
    w, cuts = toxicity._ascend(at, row, grade, size, n_grades)

    def value(w, cuts):
        s = 1 / (1 + np.exp(-((has @ w)[:, None] - cuts[None, :])))
        edges = np.hstack((np.ones((n, 1)), s, np.zeros((n, 1))))
        return np.log(np.maximum(edges[np.arange(n), grade] - edges[np.arange(n), grade + 1], 1e-12)).mean() - toxicity.RIDGE / 2 * (w**2).sum()

    def climbed(x, rounds):
        best, step = value(x[:size], x[size:]), 1.0
        for _ in range(rounds):
            moved = False
            for k in range(len(x)):
                for d in (step, -step):
                    y = x.copy()
                    y[k] += d
                    if (np.diff(y[size:]) > 0).all() and (v := value(y[:size], y[size:])) > best + 1e-12:
                        x, best, moved = y, v, True
            step = step if moved else step / 2
        return best

    plain = climbed(np.concatenate((np.zeros(size), np.arange(n_grades - 1, dtype=float))), 200)
    assert value(w, cuts) >= plain - 1e-3 and climbed(np.concatenate((w, cuts)), 60) <= value(w, cuts) + 1e-3
