"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.chat import chat_digest
from gleaner.llm.common import load
from gleaner.llm.decontamination import leaks_digest
from gleaner.llm.fingerprints import compare_edits
from gleaner.llm.language_id import language_id_digest
from gleaner.llm.line_dedup import line_dedup_digest
from gleaner.llm.merkle import merkle_digest
from gleaner.llm.mixing import mixing_digest
from gleaner.llm.near_dup import near_dup_digest
from gleaner.llm.packing import Limits, pack_documents, packing_digest
from gleaner.llm.pii import pii_digest
from gleaner.llm.spelling import spelling_digest
from gleaner.llm.toxicity import toxicity_digest
from gleaner.llm.url_filter import url_filter_digest


def vocabulary() -> str:
    """The public byte-level vocabulary; its folder is a parameter of the machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_edit_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, its text and edited text fingerprinted whole. Null texts are empty; null ids come last by
    descending id, equal ids follow each other; an empty table gives none."""
    return compare_edits(load(spark, sf_dir, "documents"))


def op2_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. Null and empty texts have no spans; repeated rows, null and repeated ids stay as they are."""
    return pii_digest(load(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. Null and empty texts are one empty line; a null id counts as one document after all others."""
    return line_dedup_digest(load(spark, sf_dir, "documents"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece. Null and empty texts are the end token; repeated rows, null and repeated ids are packed like others."""
    return packing_digest(pack_documents(load(spark, sf_dir, "documents"), vocabulary(), Limits()))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation, and one for conversation -1. Null texts and roles are empty; all rows of a null id are one
    conversation, and those that already have the id -1 are one with the added two; turns of one number go by role and text;
    an empty table gives conversation -1 alone."""
    return chat_digest(load(spark, sf_dir, "conversations"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. Null texts and texts without a letter are ``und``; null ids are not held out; null labels teach
    nothing; ties go to the first language by name."""
    return language_id_digest(load(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page. Null urls have an empty host and path; repeated rows stay; of equal rules ``block`` wins."""
    return url_filter_digest(load(spark, sf_dir, "pages"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. Null and empty texts link with nothing; a null id links, but names a component only if all its
    ids are null; rows that repeat an id are judged by their own texts."""
    return near_dup_digest(load(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. Null and empty texts have no feature; of repeated labels the highest counts, null ones do not."""
    return toxicity_digest(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it holds. Null and empty texts hold nothing; repeated rows count once."""
    return leaks_digest(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each word. Null and empty texts have none; a null id counts as an empty one; repeated rows count each; an empty
    table gives none."""
    return spelling_digest(load(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. Nulls have a mark of their own; null ids come first in their language, null languages first of
    all; repeated rows are leaves of their own; an empty table gives none."""
    return merkle_digest(load(spark, sf_dir, "documents"))


def op13_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. Null and empty texts have size 0; a null source is one of its own, the last; repeated rows queue
    one after another."""
    return mixing_digest(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_edit_sketches": op1_edit_sketches,
    "op2_private_spans": op2_private_spans,
    "op3_line_dedup": op3_line_dedup,
    "op4_vector_packing": op4_vector_packing,
    "op5_chat_format": op5_chat_format,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_near_dup": op8_near_dup,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_fair_mixing": op13_fair_mixing,
}

#: crc32 in SQL: its table of remainders as ``t``, and that of texts of code points below 256.
REMAINDERS = """remainders AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
        )"""
CRC32 = """xor(list_reduce(flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLE: dict[str, str] = {
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), shared AS (
            SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), marked AS (
            SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.first_id AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op7_url_filter": r"""
        WITH parts AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), rules(verdict, rule, rhost, rpath) AS (
            VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('block', 'net/de/', 'net', '/de/'),
                ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')
        ), fits AS (
            SELECT p.*, r.verdict, r.rule, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
            FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1""",
    "op8_near_dup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM words
        ), rows AS (SELECT doc_id, unnest(s) AS x FROM sets),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT c.a, c.b FROM common c JOIN sets p ON p.doc_id = c.a JOIN sets q ON q.doc_id = c.b
            WHERE 100 * c.n >= 85 * (len(p.s) + len(q.s) - c.n)
        ), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, sides.b FROM reach JOIN sides ON reach.r = sides.a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.r) AS component_id, s.doc_id = min(r.r) AS kept
        FROM sets s JOIN reach r ON r.d = s.doc_id GROUP BY s.doc_id, len(s.s)""",
    "op11_spelling_variants": r"""
        WITH RECURSIVE %(remainders)s, runs AS (
            SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents
        ), lowered AS (
            SELECT coalesce(doc_id::VARCHAR, '') || ':' || r AS named, r AS run, count(*) AS n
            FROM (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM runs) GROUP BY ALL
        ), hashed AS (
            SELECT run, n, %(crc32)s AS h
            FROM lowered, remainders
        ), words AS (
            SELECT CASE WHEN h %% 31 = 0 THEN left(run, (h %% length(run))::INT) || substring(run, (h %% length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
        ), holes AS (
            SELECT word, n, i, left(word, i::INT) || substring(word, i::INT + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
        ), near AS (
            SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
        ), best AS (
            SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word
        ), forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
            FROM words w LEFT JOIN best USING (word)
        ), follow AS (
            SELECT word, word AS root FROM forms UNION ALL SELECT f.word, g.form FROM follow f JOIN forms g ON f.root = g.word WHERE g.form IS NOT NULL
        )
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN follow r USING (word) JOIN forms l ON r.root = l.word WHERE l.form IS NULL""" % {"remainders": REMAINDERS, "crc32": CRC32.format("named")},
    "op12_merkle_manifest": r"""
        WITH RECURSIVE %(remainders)s, docs AS (
            SELECT doc_id, source, lang, n_chars, text, CASE WHEN doc_id IS NOT NULL AND %(crc32)s %% 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
            FROM documents, remainders
        ), hashed AS (
            SELECT doc_id, coalesce('+' || lang, '') AS named, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS changed
            FROM (SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM docs)
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY named ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY named) AS n FROM hashed
        ), inner_tree AS (
            SELECT named, 0 AS level, p, n, leaf AS hash FROM leaves
            UNION ALL SELECT named, level + 1, p // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY p)) FROM inner_tree WHERE n > 1 GROUP BY named, level, p // 8
        ), subroots AS (
            SELECT named, hash AS subroot, row_number() OVER (ORDER BY named) - 1 AS p, count(*) OVER () AS n FROM inner_tree WHERE n = 1
        ), outer_tree AS (
            SELECT 0 AS level, p, n, subroot AS hash FROM subroots
            UNION ALL SELECT level + 1, p // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY p)) FROM outer_tree WHERE n > 1 GROUP BY level, p // 8
        ), inner_runs AS (
            SELECT named, level, p // 8 AS up, string_agg(hash, '' ORDER BY p) AS run FROM inner_tree WHERE n > 1 GROUP BY ALL
        ), outer_runs AS (
            SELECT level, p // 8 AS up, string_agg(hash, '' ORDER BY p) AS run FROM outer_tree WHERE n > 1 GROUP BY ALL
        ), inner_fold AS (
            SELECT doc_id, leaf, named, 0 AS level, p, n, changed AS folded, '' AS proof FROM leaves
            UNION ALL SELECT doc_id, leaf, f.named, f.level + 1, p // 8, (n + 7) // 8, sha256(left(run, (p %% 8 * 64)::INT) || folded || substring(run, (p %% 8 * 64 + 65)::INT)), proof || left(run, (p %% 8 * 64)::INT) || substring(run, (p %% 8 * 64 + 65)::INT)
            FROM inner_fold f JOIN inner_runs r ON f.named = r.named AND f.level = r.level AND f.p // 8 = r.up WHERE n > 1
        ), outer_fold AS (
            SELECT doc_id, leaf, subroot, 0 AS level, s.p, s.n, folded, proof FROM inner_fold f JOIN subroots s USING (named) WHERE f.n = 1
            UNION ALL SELECT doc_id, leaf, subroot, f.level + 1, p // 8, (n + 7) // 8, sha256(left(run, (p %% 8 * 64)::INT) || folded || substring(run, (p %% 8 * 64 + 65)::INT)), proof || left(run, (p %% 8 * 64)::INT) || substring(run, (p %% 8 * 64 + 65)::INT)
            FROM outer_fold f JOIN outer_runs r ON f.level = r.level AND f.p // 8 = r.up WHERE n > 1
        )
        SELECT doc_id, leaf, subroot, t.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.hash AS verified
        FROM outer_fold f, outer_tree t WHERE f.n = 1 AND t.n = 1""" % {"remainders": REMAINDERS, "crc32": CRC32.format("coalesce(doc_id::VARCHAR, '')")},
    "op13_fair_mixing": r"""
        WITH sized AS (
            SELECT doc_id, coalesce('=' || source, '') AS named, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
            FROM documents
        ), weighed AS (
            SELECT named, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY named = '', named) - 1) % 3 + 1)::INT] AS weight FROM sized GROUP BY named
        ), levels AS (
            SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER earlier, 0))::DOUBLE / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, named ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed WINDOW earlier AS (ORDER BY source_size::DOUBLE / weight, named ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), share AS (
            SELECT (1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (WHERE 2 * source_size < weight * level), 0))::DOUBLE / sum(weight) FILTER (WHERE NOT 2 * source_size < weight * level) AS level FROM levels
        ), targets AS (
            SELECT named, source_size, least((2 * source_size)::DOUBLE, weight * share.level) AS target FROM weighed, share
        ), queued AS (
            SELECT s.*, t.source_size, t.target, sum(size) OVER (PARTITION BY named ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM sized s JOIN targets t USING (named)
        ), passes AS (SELECT *, unnest([0, 1]) AS pass FROM queued WHERE size > 0 AND target > 0),
        packets AS (
            SELECT named, target, start + pass * source_size + least(size, (k + 1) * 256) AS ends, least(size, (k + 1) * 256) - k * 256 AS words
            FROM (SELECT *, unnest(range((size - 1) // 256 + 1)) AS k FROM passes)
        ), run AS (
            SELECT named, ends, words, sum(words) OVER (ORDER BY ends / target, named, ends ROWS UNBOUNDED PRECEDING) AS run FROM packets
        ), reached AS (
            SELECT named, max(ends - greatest(0, run - floor(budget)))::BIGINT AS reached FROM run, (SELECT 1.5 * sum(size) AS budget FROM sized) WHERE run - words < floor(budget) GROUP BY named
        )
        SELECT doc_id, size, source_size, target, (greatest(0, least(size, coalesce(reached, 0) - start)) + greatest(0, least(size, coalesce(reached, 0) - start - source_size)))::BIGINT AS taken, coalesce(reached, 0) AS reached
        FROM queued LEFT JOIN reached USING (named)""",
}
