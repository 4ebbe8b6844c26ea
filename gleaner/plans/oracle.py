"""The queries of ``gleaner.plans.queries`` in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

import numpy as np

from gleaner.plans.queries import made_up_layers

_HASHES = """
    hashes AS (
        SELECT vec_id, label, list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 2] > embedding[i + 1] THEN (1::BIGINT << (62 - i)) ELSE 0 END))::BIGINT AS hash
        FROM embeddings
    )"""

_CROSS = f"""{_HASHES}, pairs AS (
        SELECT a.vec_id AS a, b.vec_id AS b, a.label AS group_a, b.label AS group_b, bit_count(xor(a.hash, b.hash))::INTEGER AS distance
        FROM hashes a JOIN hashes b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE bit_count(xor(a.hash, b.hash)) <= 18
    )"""

_GRIDS = r"""
    words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS word FROM documents),
    cells AS (SELECT doc_id, ((unicode(word) * 31 + length(word) * 7) % 272)::INTEGER AS cell, count(*)::BIGINT AS n FROM words GROUP BY ALL),
    maps AS (SELECT doc_id, map_from_entries(list((cell, n))) AS m FROM cells GROUP BY doc_id),
    grids AS (SELECT doc_id, list_transform(range(0, 272), lambda i: coalesce(m[i::INTEGER], 0)) AS g FROM maps),
    wide AS (
        SELECT doc_id, list_transform(range(0, 256), lambda k: CASE WHEN g[(k // 16) * 17 + k % 16 + 2] > g[(k // 16) * 17 + k % 16 + 1] THEN 1 ELSE 0 END) AS bits FROM grids
    ), hashed AS (
        SELECT doc_id, list_transform(range(0, 4), lambda w: array_to_string(bits[w * 64 + 1 : w * 64 + 64], '')::BIT) AS words FROM wide
    )"""


def _near_grids(words: int, threshold: int) -> str:
    apart = " + ".join(f"bit_count(xor(a.words[{w}], b.words[{w}]))" for w in range(1, words + 1))
    return f"WITH {_GRIDS} SELECT a.doc_id AS a, b.doc_id AS b, ({apart})::INTEGER AS distance FROM hashed a JOIN hashed b ON a.doc_id < b.doc_id WHERE {apart} <= {threshold}"


_COSINE = """
    alike AS (
        SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
        FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
    )"""

_FEATURES = """
    features AS (
        SELECT vec_id,
            list_transform(range(0, 16), lambda k: len(list_filter(embedding::DOUBLE[], lambda x: greatest(0, least(15, floor((x + 0.5) * 16)::INTEGER)) = k)) / len(embedding)) AS histogram,
            list_transform(embedding::DOUBLE[], lambda x: round(x * 100, 4)) AS gray
        FROM embeddings
    )"""

_NEXT = _FEATURES + ", beside AS (SELECT a.vec_id, a.histogram AS h, b.histogram AS o, a.gray AS g, b.gray AS p FROM features a JOIN features b ON b.vec_id = a.vec_id + 1)"

_RANKED = """
    ranked AS (
        SELECT doc_id, md5(coalesce(text, '')) AS hash, strlen(coalesce(text, '')) AS bytes,
            row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY n_chars DESC, strlen(coalesce(text, '')) DESC, doc_id) AS rank
        FROM documents
    )"""

_PHRASES = r"""
    parts AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), ',')) AS raw, generate_subscripts(string_split(coalesce(text, ''), ','), 1) AS k FROM documents
    ), stripped AS (SELECT doc_id, k, lower(regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '')) AS phrase FROM parts),
    spoken AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS position FROM stripped WHERE phrase <> ''),
    counted AS (
        SELECT phrase, count(*)::BIGINT AS n, min(doc_id) AS first_key, arg_min(position, (doc_id, position))::INTEGER AS first_position FROM spoken GROUP BY phrase
    )"""


def _centroids(rows: str, by: str) -> str:
    return f"""
    places AS (SELECT {by}, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM {rows}),
    means AS (SELECT {by}, i, avg(x) AS x FROM places GROUP BY {by}, i),
    model AS (SELECT {by}, list(x ORDER BY i) AS v FROM means GROUP BY {by}),
    centroids AS (SELECT {by}, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS c FROM model)"""


def _metrics(counts: str, keys: str = "") -> str:
    return f"""
    SELECT {keys} tn, fp, fn, tp, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6)::DOUBLE AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision,
        round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1
    FROM {counts}"""


def _counts(rows: str, truth: str, said: str, keys: str = "") -> str:
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""(SELECT {keys} (count(*) FILTER (NOT ({truth}) AND NOT ({said})))::BIGINT AS tn, (count(*) FILTER (NOT ({truth}) AND ({said})))::BIGINT AS fp,
        (count(*) FILTER (({truth}) AND NOT ({said})))::BIGINT AS fn, (count(*) FILTER (({truth}) AND ({said})))::BIGINT AS tp FROM {rows} {group})"""


_PREDICTED = f"""{_centroids("embeddings", "label")}, scored AS (
        SELECT e.vec_id, e.label, list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE * p.c[i])) AS sim_positive, list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE * n.c[i])) AS sim_negative
        FROM embeddings e, centroids p, centroids n WHERE p.label = 0 AND n.label = 1
    ), judged AS (
        SELECT *, CASE WHEN sim_positive > sim_negative THEN 0 ELSE 1 END AS predicted, 1 / (1 + exp(-20 * (sim_positive - sim_negative))) AS p FROM scored
    )"""

_FOLDED = f"""
    folded AS (SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id)) - 1) % 5)::INTEGER AS own FROM embeddings WHERE label IN (0, 1)),
    train AS (SELECT f.label, f.embedding, k.fold FROM folded f, (SELECT unnest(range(0, 5))::INTEGER AS fold) k WHERE f.own <> k.fold),
    {_centroids("train", "fold, label")}, scored AS (
        SELECT f.own AS fold, f.label, list_sum(list_transform(range(1, 65), lambda i: f.embedding[i]::DOUBLE * p.c[i])) AS sp, list_sum(list_transform(range(1, 65), lambda i: f.embedding[i]::DOUBLE * n.c[i])) AS sn
        FROM folded f JOIN centroids p ON p.fold = f.own AND p.label = 0 JOIN centroids n ON n.fold = f.own AND n.label = 1
    ), per_fold AS ({_metrics(_counts("scored", "label = 0", "sp > sn", "fold, "), "fold, ")})"""

_FLAGGED = """
    flagged AS (
        SELECT d.doc_id, d.n_chars / 10.0 AS blur, l.toxic * 0.2 AS asymmetry, l.quality * 0.5 + 0.1 AS confidence, l.quality + d.doc_id % 7 / 10.0 AS aesthetic,
            list_filter([CASE WHEN d.n_chars / 10.0 < 100.0 THEN 'blurry' END, CASE WHEN l.toxic * 0.2 > 0.18 THEN 'asymmetric face' END,
                CASE WHEN d.doc_id % 50 / 1000.0 < 0.01 THEN 'fingers too close' END, CASE WHEN d.doc_id % 30 / 1000.0 < 0.01 THEN 'fingers too close' END,
                CASE WHEN l.quality * 0.5 + 0.1 < 0.55 THEN 'uncertain hand' END, CASE WHEN l.quality + d.doc_id % 7 / 10.0 < 0.3 THEN 'low aesthetic score' END], lambda m: m IS NOT NULL) AS issues
        FROM documents d LEFT JOIN labels l USING (doc_id)
    ), rounded AS (
        SELECT doc_id, len(issues)::INTEGER AS n_issues, array_to_string(issues, '; ') AS issue_text, round(blur, 1)::DOUBLE AS blur_rounded, round(aesthetic, 3)::DOUBLE AS aesthetic_rounded FROM flagged
    )"""

#: What is drawn of each vector: its file's name and folder, and its samples over white, unless the file is broken.
_DRAWN = """
    drawn AS (
        SELECT vec_id, label, ['.PNG', '.png', '.jpg', '.txt', '.webp'][vec_id % 5 + 1] AS ext, printf('v%06d', vec_id) || ['.PNG', '.png', '.jpg', '.txt', '.webp'][vec_id % 5 + 1] AS filename,
            printf('%02d', label) AS sub, vec_id % 7 = 0 AS broken, (vec_id * 7 % 256) / 255.0::DOUBLE AS a,
            list_transform(range(0, 72), lambda i: greatest(0, least(255, floor((embedding[i % 64 + 1]::DOUBLE + 0.5) * 255)))) AS v
        FROM embeddings
    ), seen AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN list_transform(v, lambda x: round_even(x * a + 255 * (1 - a), 0)) ELSE v END AS s FROM drawn)"""

_URL = r"regexp_extract(url, '\?([^#]*)', 1)"
_PAIRS = f"list_filter(string_split({_URL}, '&'), lambda p: regexp_extract(p, '=(.+)$', 1) <> '')"


def _linear_stack() -> str:
    """The layers of ``aesthetic_mlp``, which are linear, as one row of weights and one bias."""
    weights, bias = np.eye(64), np.zeros(64)
    for w, b in made_up_layers():
        weights, bias = w @ weights, w @ bias + b
    return f"SELECT vec_id, round({float(bias[0])!r} + list_dot_product(embedding::DOUBLE[], {[float(x) for x in weights[0]]!r}::DOUBLE[]), 6) AS score FROM embeddings"


ORACLE: dict[str, str] = {
    "aesthetic_mlp": _linear_stack(),
    "dedup_best_of_group": f"WITH {_RANKED} SELECT doc_id, hash, rank FROM ranked WHERE rank > 1",
    "dedup_totals": f"""
        WITH {_RANKED}, sizes AS (SELECT hash, count(*) AS n, sum(bytes) FILTER (WHERE rank > 1) AS b FROM ranked GROUP BY hash HAVING count(*) > 1)
        SELECT count(*)::BIGINT AS n_groups, coalesce(sum(n - 1), 0)::BIGINT AS n_redundant, coalesce(sum(b), 0)::BIGINT AS redundant_bytes FROM sizes""",
    "dhash_vectors": f"WITH {_HASHES} SELECT vec_id, hash FROM hashes",
    "hamming_wide": _near_grids(4, 10),
    "hamming_wide_close": _near_grids(4, 2),
    "hamming_wide_turned": _near_grids(4, 20),
    "hamming_pairs_indexed": _near_grids(1, 6),
    "hamming_pairs": f"""
        WITH {_HASHES} SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.hash, b.hash))::INTEGER AS distance
        FROM hashes a JOIN hashes b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.hash, b.hash)) <= 14""",
    "hamming_pairs_banded": """
        WITH h AS (SELECT c_custkey AS k, xor(c_custkey >> 3, c_nationkey::BIGINT * 1099511627776) AS hash FROM customer)
        SELECT a.k AS a, b.k AS b, bit_count(xor(a.hash, b.hash))::INTEGER AS distance FROM h a JOIN h b ON a.k < b.k WHERE bit_count(xor(a.hash, b.hash)) <= 1""",
    "hamming_pairs_cross_group": f"WITH {_CROSS} SELECT a, b, distance FROM pairs",
    "group_pair_counts": f"""
        WITH {_CROSS} SELECT array_to_string(list_sort([group_a::VARCHAR, group_b::VARCHAR]), ' <-> ') AS groups, count(*)::BIGINT AS n FROM pairs GROUP BY 1""",
    "groups_in_pairs": f"WITH {_CROSS} SELECT group_a AS label FROM pairs UNION SELECT group_b FROM pairs",
    "cosine_pairs": f"WITH {_COSINE} SELECT a, b, round(similarity, 6) AS similarity FROM alike WHERE similarity > 0.4",
    "duplicate_components": f"""
        WITH RECURSIVE {_COSINE}, edges AS (SELECT a, b FROM alike WHERE similarity > 0.4), sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        reach AS (SELECT a AS node, a AS r FROM sides UNION SELECT reach.node, sides.b FROM reach JOIN sides ON reach.r = sides.a)
        SELECT node, min(r) AS component FROM reach GROUP BY node""",
    "histogram_intersection": f"WITH {_NEXT} SELECT vec_id, round(list_sum(list_transform(range(1, 17), lambda i: least(h[i], o[i]))), 6) AS intersection FROM beside",
    "mad_and_ratio": f"""
        WITH {_NEXT} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(g[i] - p[i]))) / 64, 6) AS difference,
            round(len(list_filter(range(1, 65), lambda i: abs(g[i] - p[i]) >= 15)) / 64, 6) AS ratio FROM beside""",
    "verified_pairs": f"""
        WITH {_COSINE}, {_FEATURES}, scored AS (
            SELECT s.a, s.b, list_sum(list_transform(range(1, 17), lambda i: least(x.histogram[i], y.histogram[i]))) AS histogram,
                list_sum(list_transform(range(1, 65), lambda i: abs(x.gray[i] - y.gray[i]))) / 64 AS difference, len(list_filter(range(1, 65), lambda i: abs(x.gray[i] - y.gray[i]) >= 25)) / 64 AS ratio
            FROM alike s JOIN features x ON x.vec_id = s.a JOIN features y ON y.vec_id = s.b WHERE s.similarity > 0.35
        )
        SELECT a, b, round(histogram, 6) AS histogram, round(difference, 6) AS difference, round(ratio, 6) AS ratio FROM scored WHERE histogram >= 0.8 AND difference <= 11 AND ratio <= 0.1""",
    "simple_vector_filter": """
        WITH cells AS (SELECT vec_id, unnest(list_transform(embedding::DOUBLE[], lambda x: floor(x * 20.0)::INTEGER)) AS b FROM embeddings),
        counts AS (SELECT vec_id, b, count(*) AS n FROM cells GROUP BY ALL), top AS (SELECT vec_id, arg_min(b, (-n, b)) AS m FROM counts GROUP BY vec_id),
        shares AS (SELECT c.vec_id, round(1 - sum(n) FILTER (WHERE abs(c.b - t.m) <= 1) / sum(n), 6) AS content FROM counts c JOIN top t USING (vec_id) GROUP BY c.vec_id)
        SELECT vec_id, content FROM shares WHERE content >= 0.4""",
    "trim_box": """
        WITH corners AS (SELECT vec_id, unnest([embedding[1], embedding[8], embedding[57], embedding[64]])::DOUBLE AS v, unnest([1, 2, 3, 4]) AS k FROM embeddings),
        often AS (SELECT vec_id, v, count(*) AS n, min(k) AS k FROM corners GROUP BY vec_id, v), back AS (SELECT vec_id, arg_min(v, (-n, k)) AS b FROM often GROUP BY vec_id),
        cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
        boxes AS (
            SELECT vec_id, min(i % 8) AS l, min(i // 8) AS t, max(i % 8) AS r, max(i // 8) AS d FROM cells JOIN back USING (vec_id) WHERE abs(x - b) > 0.2 GROUP BY vec_id
        )
        SELECT e.vec_id, greatest(0, l - 1)::INTEGER AS "left", greatest(0, t - 1)::INTEGER AS top, least(8, r + 2)::INTEGER AS "right", least(8, d + 2)::INTEGER AS bottom
        FROM embeddings e LEFT JOIN boxes USING (vec_id)""",
    "laplacian_variance": """
        WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        cells AS (
            SELECT vec_id, unnest(list_transform(list_filter(range(1, 65), lambda i: (i - 1) % 8 BETWEEN 1 AND 6 AND i > 8 AND i <= 56), lambda i: v[i - 1] + v[i + 1] + v[i - 8] + v[i + 8] - 4 * v[i])) AS s FROM d
        )
        SELECT vec_id, round(var_pop(s), 6) AS variance FROM cells GROUP BY vec_id""",
    "centroid_train": f"WITH {_centroids('embeddings', 'label')} SELECT label, (generate_subscripts(c, 1) - 1)::INTEGER AS i, round(unnest(c), 6) AS x FROM centroids",
    "centroid_predict": f"""
        WITH {_PREDICTED} SELECT vec_id, predicted::INTEGER AS predicted, round(CASE WHEN predicted = 0 THEN p ELSE 1 - p END, 6) AS confidence, round(sim_positive, 6) AS sim_positive, round(sim_negative, 6) AS sim_negative FROM judged""",
    "centroid_metrics": f"WITH {_PREDICTED} {_metrics(_counts('(SELECT * FROM judged WHERE label IN (0, 1))', 'label = 0', 'predicted = 0'))}",
    "kfold_metrics": f"WITH {_FOLDED} SELECT * FROM per_fold",
    "kfold_summary": f"""
        WITH {_FOLDED} SELECT sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp)::BIGINT AS tp, round(avg(accuracy), 4) AS accuracy, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM per_fold""",
    "label_metrics": _metrics(_counts("labels", "quality = 1", "toxic = 0")),
    "cluster_rank": f"""
        WITH {_centroids("embeddings", "label")}, scored AS (
            SELECT e.vec_id, e.label, list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE * c.c[i])) AS s FROM embeddings e JOIN centroids c USING (label)
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS rank FROM scored)
        SELECT vec_id, label, round(s, 6) AS similarity, rank::INTEGER AS rank, printf('%02d', label) AS folder, printf('%04d', rank) || '_v' || vec_id || '.png' AS target FROM ranked""",
    "phrase_frequency": f"WITH {_PHRASES} SELECT * FROM counted",
    "phrase_rank": f"WITH {_PHRASES} SELECT phrase, n, row_number() OVER (ORDER BY n DESC, first_key, first_position, phrase) AS rank FROM counted",
    "phrase_report": f"""
        WITH {_PHRASES}, best AS (SELECT * FROM counted ORDER BY n DESC, first_key, first_position, phrase LIMIT 20)
        SELECT '{{"n_prompts":' || (SELECT count(text) FROM documents) || ',"n_phrases":' || (SELECT count(*) FROM counted) || ',"n_occurrences":' || (SELECT sum(n) FROM counted)
            || ',"phrases":[' || string_agg('{{"phrase":' || to_json(phrase) || ',"n":' || n || '}}', ',' ORDER BY n DESC, first_key, first_position, phrase) || ']}}' AS value FROM best""",
    "mode_of_group": """
        WITH c AS (SELECT p_brand, p_size, count(*)::BIGINT AS n, arg_min(p_name || '/' || printf('%08d', p_partkey), lower(p_name || '/' || printf('%08d', p_partkey))) AS path FROM part GROUP BY ALL)
        SELECT p_brand, p_size, n, path FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size DESC) AS k FROM c) WHERE k = 1""",
    "resolution_report": r"""
        WITH c AS (SELECT p_brand, p_size AS w, p_size % 7 + 1 AS h, count(*) AS n, min(p_brand || '/' || printf('%08d', p_partkey)) AS path FROM part GROUP BY ALL)
        SELECT w || 'x' || h || chr(9) || path AS value FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, w * h DESC, w DESC, h DESC) AS k FROM c) WHERE k = 1""",
    "low_mean_filter": "SELECT user_id, round(avg(value), 6) AS mean_value, count(value)::BIGINT AS n FROM events GROUP BY user_id HAVING avg(value) <= 100 OR avg(value) IS NULL",
    "quality_flags": f"WITH {_FLAGGED} SELECT * FROM rounded",
    "quality_top20": f"""
        WITH {_FLAGGED}, clean AS (SELECT doc_id, row_number() OVER (ORDER BY aesthetic_rounded DESC NULLS LAST, blur_rounded DESC, doc_id) AS rank, count(*) OVER () AS n FROM rounded WHERE n_issues = 0)
        SELECT doc_id, rank FROM clean WHERE rank <= ceil(0.2 * n)""",
    "media_info": """
        WITH raw AS (SELECT l_orderkey, l_linenumber, (l_partkey % 1920)::INTEGER AS w, (l_suppkey % 1080)::INTEGER AS h, l_linenumber * 10.0::DOUBLE - 10 AS fps, l_quantity * 100000 - 100000 AS frames, l_extendedprice * 1000 AS size FROM lineitem),
        timed AS (SELECT *, CASE WHEN frames > 0 AND fps > 0 AND w > 0 AND h > 0 THEN frames / fps END AS d FROM raw), whole AS (SELECT *, floor(d)::BIGINT AS s FROM timed)
        SELECT l_orderkey, l_linenumber, CASE WHEN w > 0 AND h > 0 THEN w || 'x' || h END AS resolution, CASE WHEN w > 0 AND h > 0 THEN w::BIGINT * h END AS pixels, round(d, 6) AS duration,
            CASE WHEN s >= 86400 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ', ' ELSE '' END || (s % 86400 // 3600) || ':' || printf('%02d', s % 3600 // 60) || ':' || printf('%02d', s % 60) AS clock,
            CASE WHEN d > 0 THEN round_even(size * 8.0 / 1000.0 / d, 0)::BIGINT END AS bitrate_kbps
        FROM whole""",
    "url_normalise": f"""
        WITH q AS (SELECT page_id, url, {_PAIRS} AS pairs FROM pages)
        SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '?' || array_to_string(list_append(list_filter(pairs, lambda p: string_split(p, '=')[1] <> 'name'), 'name=orig'), '&') || regexp_extract(url, '(#.*)$', 1) AS normal_url FROM q""",
    "url_filename": rf"""
        WITH q AS (SELECT page_id, url, {_PAIRS} AS pairs FROM pages)
        SELECT page_id, '@' || coalesce(nullif(regexp_replace(regexp_extract(url, '://([^/]+)', 1), '[^\p{{L}}\p{{N}}_-]', '', 'g'), ''), 'unknown') || '_' || md5(url) || '.'
            || coalesce(regexp_extract(list_filter(pairs, lambda p: starts_with(p, 'format='))[1], '=(.*)$', 1), 'jpg') AS filename,
            coalesce(regexp_extract(list_filter(pairs, lambda p: starts_with(p, 'ref='))[1], '=(.*)$', 1), 'none') AS ref FROM q""",
    "link_extract_first_seen": """
        WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages), r AS (SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS position FROM l)
        SELECT link, min(page_id) AS page_id, arg_min(position, (page_id, position))::INTEGER AS position FROM r GROUP BY link""",
    "existing_anti_join": "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
    "substring_anti_join": "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE contains(p.url, s.s_suppkey::VARCHAR))",
    "convert_dispatch": r"""
        WITH f AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || ['.PNG', '.jpeg', '.jpg', '.html'][page_id % 4 + 1] AS path FROM pages)
        SELECT page_id, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ext, CASE lower(regexp_extract(path, '(\.[^./]+)$', 1)) WHEN '.png' THEN 'convert' WHEN '.jpeg' THEN 'rename' ELSE 'keep' END AS action,
            regexp_replace(path, '\.[^./]+$', '') || '.jpg' AS target FROM f""",
    "convert_plan": """
        WITH f AS (SELECT DISTINCT 'in/p' || (p_partkey // 3) AS stem, ['.png', '.jpeg', '.jpg', '.txt'][p_partkey % 4 + 1] AS ext FROM part),
        t AS (SELECT stem || ext AS src, stem || '.jpg' AS dst, CASE ext WHEN '.png' THEN 'convert' ELSE 'rename' END AS action FROM f WHERE ext IN ('.png', '.jpeg'))
        SELECT src, dst, CASE WHEN row_number() OVER (PARTITION BY dst ORDER BY src) > 1 OR dst IN (SELECT stem || ext FROM f) THEN 'error' ELSE action END AS action FROM t""",
    "duplicate_plan": f"""
        WITH {_RANKED}, moved AS (SELECT 'in/' || printf('%08d', doc_id) || '/d' || doc_id % 20 || '.txt' AS src, 'duplicates/d' || doc_id % 20 AS stem FROM ranked WHERE rank > 1),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY src) - 1 AS k FROM moved)
        SELECT src, stem || CASE WHEN k = 0 THEN '' ELSE '_' || k END || '.txt' AS dst, 'move' AS action FROM numbered""",
    "keeper_metrics": """
        WITH kept AS (SELECT label, max(vec_id) AS kept_key FROM embeddings GROUP BY label)
        SELECT k.label, k.kept_key, e.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(e.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / 64, 6) AS difference
        FROM kept k JOIN embeddings b ON b.vec_id = k.kept_key JOIN embeddings e ON e.label = k.label AND e.vec_id <> k.kept_key""",
    "asymmetry": """
        WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
        SELECT vec_id, round(list_sum(list_transform(range(1, 4), lambda i: abs(abs(v[7] - v[i]) - abs(v[i + 3] - v[7])))) / 3 / abs(v[8] - v[9]), 6) AS asymmetry FROM d""",
    "min_tip_distance": """
        WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
        SELECT vec_id, round(list_min(flatten(list_transform(range(1, 6), lambda i: list_transform(range(i + 1, 6), lambda j: sqrt((v[i] - v[j]) ** 2 + (v[i + 5] - v[j + 5]) ** 2))))), 6) AS distance FROM d""",
    "saturation": """
        WITH c AS (SELECT p_brand, p_partkey * 7 % 256 AS r, p_partkey * 31 % 256 AS g, p_partkey * 131 % 256 AS b FROM part),
        s AS (SELECT p_brand, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) * 255 // greatest(r, g, b) ELSE 0 END AS s FROM c)
        SELECT p_brand, round(avg(s), 6) AS saturation, avg(s) <= 10 AS monochrome FROM s GROUP BY p_brand""",
    "crop_boxes": """
        WITH b AS (SELECT l_orderkey, l_linenumber AS k, l_quantity - 10 AS x1, l_linenumber::DOUBLE AS y1, l_quantity + round(l_discount * 200) - 10 AS x2, l_linenumber + round(l_tax * 300) AS y2 FROM lineitem),
        best AS (SELECT l_orderkey, arg_min({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}, (-((x2 - x1) * (y2 - y1)), k, x1, y1, x2, y2)) AS b FROM b WHERE (x2 - x1) * (y2 - y1) > 0 GROUP BY l_orderkey),
        w AS (SELECT l_orderkey, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2, (b.x2 - b.x1) * 0.25::DOUBLE AS dx, (b.y2 - b.y1) * 0.25::DOUBLE AS dy FROM best)
        SELECT l_orderkey, greatest(0, trunc(x1 - dx)::INTEGER) AS "left", greatest(0, trunc(y1 - dy)::INTEGER) AS top, least(50, trunc(x2 + dx)::INTEGER) AS "right", least(20, trunc(y2 + dy)::INTEGER) AS bottom FROM w""",
    "session_cookies": r"""
        WITH c AS (
            SELECT 'id' || page_id AS name, md5(url) AS v, CASE WHEN page_id % 3 > 0 THEN CASE WHEN page_id % 2 = 0 THEN '.' ELSE '' END || regexp_extract(url, '://([^/]+)', 1) ELSE '' END AS domain,
                CASE WHEN page_id % 5 > 0 THEN page_id * 1000 ELSE 0 END AS expires, page_id % 2 = 1 AS secure FROM pages
        )
        SELECT domain || chr(9) || CASE WHEN starts_with(domain, '.') THEN 'TRUE' ELSE 'FALSE' END || chr(9) || '/' || chr(9) || CASE WHEN secure THEN 'TRUE' ELSE 'FALSE' END || chr(9) || expires || chr(9) || name || chr(9) || v AS value FROM c""",
    "pair_report": f"""
        WITH {_CROSS} SELECT row_number() OVER (ORDER BY distance, a, b) || '. ' || a || ' <-> ' || b || ' (' || distance || ')' AS value FROM pairs
        UNION ALL SELECT label::VARCHAR FROM (SELECT group_a AS label FROM pairs UNION SELECT group_b FROM pairs)
        UNION ALL SELECT array_to_string(list_sort([group_a::VARCHAR, group_b::VARCHAR]), ' <-> ') || ': ' || count(*) FROM pairs GROUP BY list_sort([group_a::VARCHAR, group_b::VARCHAR])""",
    "similar_images_report": f"""
        WITH {_CROSS}, named AS (
            SELECT a, b, distance, printf('folder %02d', group_a::INTEGER) AS fa, printf('folder %02d', group_b::INTEGER) AS fb, printf('v%06d.png', a) AS na, printf('v%06d.png', b) AS nb, row_number() OVER (ORDER BY a, b) AS k FROM pairs
        ), counts AS (SELECT array_to_string(list_sort([fa, fb]), ' <-> ') AS two, count(*) AS n FROM named GROUP BY 1),
        lines AS (
            SELECT 0 AS s, 0 AS k, '' AS key, unnest([repeat('=', 60), count(*) || ' 件の類似画像ペアが見つかりました。', repeat('=', 60), '']) AS value, unnest(range(4)) AS part FROM named
            UNION ALL SELECT 1, k, '', unnest(['ペア ' || k || ': ハミング距離 ' || distance || '  |  フォルダ間: ' || array_to_string(list_sort([fa, fb]), ' <-> '), '  [' || fa || '] ' || na, '  [' || fb || '] ' || nb, '']), unnest(range(4)) FROM named
            UNION ALL SELECT 2, 0, '', unnest([repeat('-', 60), '類似画像が見つかったフォルダ間:']), unnest(range(2))
            UNION ALL SELECT 2, 1, two, '  ' || two || ': ' || n || ' 件', 0 FROM counts
            UNION ALL SELECT 3, 0, '', unnest(['', repeat('-', 60), '類似画像がある親フォルダ名:', '  images: ' || (SELECT string_agg(f, ', ' ORDER BY f) FROM (SELECT fa AS f FROM named UNION SELECT fb FROM named))]), unnest(range(4))
        )
        SELECT row_number() OVER (ORDER BY s, k, key, part) AS line, value FROM lines""",
    "prediction_report": f"""
        WITH {_PREDICTED} SELECT 'filepath,predicted_label,confidence,similarity_illust,similarity_photo' AS value UNION ALL SELECT '"v/' || printf('%06d', vec_id) || '.png",' || predicted || ',' || printf('%.4f', CASE WHEN predicted = 0 THEN p ELSE 1 - p END) || ',' || printf('%.4f', sim_positive) || ',' || printf('%.4f', sim_negative) AS value FROM judged""",
    "scan_images_recursive": f"WITH {_DRAWN} SELECT filename, lower(ext) AS ext, vec_id FROM drawn WHERE ext <> '.txt'",
    "scan_images_flat": f"""
        WITH {_DRAWN}, flat AS (SELECT filename FROM drawn WHERE ext <> '.txt' AND label = 0)
        SELECT filename, 'folder' AS given FROM flat UNION ALL SELECT min(filename), 'file' FROM flat""",
    "scan_by_folder": f"WITH {_DRAWN} SELECT filename, sub AS top_folder, sub AS own_folder FROM drawn WHERE ext <> '.txt' AND label > 1",
    "image_header_sizes": f"WITH {_DRAWN} SELECT vec_id, CASE WHEN NOT broken THEN 9 END::INTEGER AS width, CASE WHEN NOT broken THEN 8 END::INTEGER AS height, CASE WHEN NOT broken THEN 1 END::INTEGER AS orientation FROM drawn",
    "converted_images": f"WITH {_DRAWN} SELECT vec_id, NOT broken AS converted, CASE WHEN NOT broken THEN 9 END::INTEGER AS width, CASE WHEN NOT broken THEN 8 END::INTEGER AS height, CASE WHEN NOT broken THEN true END AS alike, NOT broken AS gone FROM drawn WHERE lower(ext) = '.png'",
    "image_features": f"""
        WITH {_DRAWN} SELECT vec_id, 9::INTEGER AS width, 8::INTEGER AS height,
            list_sum(list_transform(range(0, 64), lambda i: CASE WHEN s[i // 8 * 9 + i % 8 + 2] > s[i // 8 * 9 + i % 8 + 1] THEN CASE WHEN i = 0 THEN -9223372036854775808 ELSE 1::BIGINT << (63 - i) END ELSE 0 END))::BIGINT AS hash,
            len(list_distinct(s))::INTEGER AS n_shades, round(list_avg(s), 6) AS mean, 0.0::DOUBLE AS saturation FROM seen WHERE NOT broken""",
    "undecodable_files": f"WITH {_DRAWN} SELECT vec_id FROM drawn WHERE broken",
    "moved_images": f"""
        WITH {_DRAWN}, named AS (SELECT row_number() OVER (PARTITION BY vec_id % 40, lower(ext) ORDER BY vec_id) AS k FROM drawn WHERE ext <> '.txt')
        SELECT CASE WHEN k = 1 THEN 'move' ELSE 'error' END AS action, (count(*) FILTER (k = 1))::BIGINT AS processed, (count(*) FILTER (k > 1))::BIGINT AS skipped, 0::BIGINT AS failed FROM named GROUP BY k = 1""",
    "csv_report": r"""
        SELECT chr(65279) || 's_suppkey,name,nation' AS value
        UNION ALL SELECT s_suppkey || ',"say ""a"", ' || CASE WHEN s_suppkey % 3 = 0 THEN chr(10) ELSE '' END || s_name || '",' || CASE WHEN s_nationkey > 3 THEN s_nationkey::VARCHAR ELSE '' END FROM supplier""",
    "saved_model": f"""
        WITH {_PREDICTED.replace('p.label = 0', 'p.label = 2').replace('n.label = 1', 'n.label = 3').replace('THEN 0 ELSE 1 END', 'THEN 2 ELSE 3 END')}
        SELECT vec_id, predicted::INTEGER AS predicted, round(CASE WHEN predicted = 2 THEN p ELSE 1 - p END, 6) AS confidence FROM judged""",
    "encoded_names": r"""
        SELECT page_id, url_encode(regexp_extract(url, '([^/]*)$', 1) || ' é*~') AS name, CASE WHEN length(regexp_extract(url, '://([^/]+)', 1)) > 0 THEN regexp_extract(url, '://([^/]+)', 1) END AS handle,
            strftime(DATE '2024-01-31' + page_id::INTEGER, '%Y%m%d') AS stamp FROM pages""",
    "worst_face": """
        WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        f AS (SELECT vec_id, unnest(list_transform([2, 12], lambda k: CASE WHEN v[k + 7] > 0 THEN list_sum(list_transform(range(0, 3), lambda i: abs(abs(v[k + 6] - v[k + i - 1]) - abs(v[k + i + 2] - v[k + 6])))) / 3 / v[k + 7] END)) AS a FROM d)
        SELECT vec_id, round(max(a), 6) AS asymmetry FROM f GROUP BY vec_id""",
    "page_outlines": r"""
        WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, html FROM pages)
        SELECT page_id, replace(title, '&amp;', '&') AS title, replace(heading, '&amp;', '&') AS heading, len(regexp_extract_all(html, '<a href="'))::INTEGER AS n_links,
            len(regexp_extract_all(html, '<p>'))::INTEGER AS n_paragraphs, len(regexp_extract_all(html, '<article>'))::INTEGER AS n_articles FROM p""",
    "page_posts": """
        SELECT page_id, 'https://i.example/' || page_id AS image, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END::INTEGER AS n_videos,
            CASE WHEN page_id % 4 > 0 THEN '/u/status/' || page_id ELSE 'https://v.example/' || page_id END AS video_key, 'user' || page_id % 9 AS username
        FROM pages WHERE page_id % 3 = 0 AND (page_id % 4 > 0 OR page_id % 2 = 1)""",
    "stream_first_seen": "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "empty_run_stop": """
        WITH m AS (SELECT DISTINCT epoch(ts)::BIGINT // 60 AS b FROM events WHERE ts IS NOT NULL), g AS (SELECT b, lead(b) OVER (ORDER BY b) AS n FROM m)
        SELECT make_timestamp(((min(b) + 6) * 60 * 1000000)::BIGINT) AS stopped_at FROM g WHERE n - b > 6""",
    "flagship": f"""
        WITH RECURSIVE {_COSINE}, {_FEATURES}, edges AS (
            SELECT s.a, s.b FROM alike s JOIN features x ON x.vec_id = s.a JOIN features y ON y.vec_id = s.b
            WHERE s.similarity > 0.35 AND list_sum(list_transform(range(1, 17), lambda i: least(x.histogram[i], y.histogram[i]))) >= 0.5
        ), sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        reach AS (SELECT a AS node, a AS r FROM sides UNION SELECT reach.node, sides.b FROM reach JOIN sides ON reach.r = sides.a),
        parts AS (SELECT node, min(r) AS component FROM reach GROUP BY node),
        ranked AS (SELECT node, component, row_number() OVER (PARTITION BY component ORDER BY label DESC, node) AS rank FROM parts JOIN embeddings ON vec_id = node)
        SELECT node AS vec_id, component, rank::INTEGER AS rank, rank = 1 AS kept FROM ranked""",
}
