"""Named queries of the corpus operators, and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, langid, merkle, minhash, ngram, packing, phrases, quality, repeats, tokenfiles, topk, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; TOKENIZER_DIR names another folder that holds it."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_minhash_near_dedup")
def minhash_near_dedup(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op4_substring_dedup")
def substring_dedup(spark, folder):
    return repeats.removal_report(table(spark, folder, "documents"))


@query("op3_bpe_round_trip")
def bpe_round_trip(spark, folder):
    return bpe.digests(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query("op8_best_fit_packing")
def best_fit_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query("op10_token_files")
def token_files(spark, folder):
    return tokenfiles.round_trip(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op6_exact_top_k", """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""")
def exact_top_k(spark, folder):
    rows = topk.quantised(table(spark, folder, "embeddings"))
    return topk.nearest(rows, rows.where("vec_id % 20 = 0"), 20)


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op7_lm_scoring")
def lm_scoring(spark, folder):
    return ngram.score(table(spark, folder, "documents"), remainder(7) == 2)


# The tables hold no redirects and no canonical links; groups of aliases are checked in the tests.
@query("op9_url_filter", """
    WITH u AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ), r AS (
        SELECT *, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
        FROM u
    )
    SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""")
def url_filter(spark, folder):
    return urlfilter.judge(table(spark, folder, "pages")).drop("alias_group")


@query("op5_document_fingerprints")
def document_fingerprints(spark, folder):
    return fingerprints.edited_likeness(table(spark, folder, "documents"))


@query("op2_language_id")
def language_id(spark, folder):
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    rows = langid.predict(table(spark, folder, "documents"), remainder(4) != 2)
    return rows.select("doc_id", held_out, "lang_pred", "score")


@query("op11_phrase_mining", r"""
    WITH pieces AS (
        SELECT d AS doc, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM (SELECT row_number() OVER () AS d, lang, text FROM documents)
    ), w AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), f AS (
        SELECT lang, phrase, k, CAST(count(*) AS HUGEINT) AS a FROM (
            SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) s
        ) GROUP BY lang, k, phrase
    ), n AS (
        SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
    ), c AS (
        SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 100
    ), cuts AS (
        SELECT lang, phrase, k, a, cut, array_to_string(w[:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
    ), scored AS (
        SELECT cuts.*, l.a AS l, r.a AS r, n.n, (1000 * cuts.a * n.n) // (l.a * r.a) AS score
        FROM cuts JOIN n USING (lang) JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = rest
    ), lowest AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
    ), longer AS (
        SELECT lang, array_to_string(part, ' ') AS phrase, max(a) AS most
        FROM (SELECT lang, a, unnest([w[:k - 1], w[2:]]) AS part FROM c WHERE k > 2) GROUP BY lang, part
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
        CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * most < 100 * a, true)
    QUALIFY rank <= 2000
""")
def phrase_mining(spark, folder):
    return phrases.ranked(table(spark, folder, "documents"))


# CRC-32 of a decimal number in SQL: a table of 256 entries by the rule of the polynomial, then byte by byte.
_CRC = """list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))),
    lambda a, b: xor(a >> 8, crc_table.t[(xor(a, b) & 255) + 1]))"""


def _leaf_sql(n_chars: str) -> str:
    fields = [("doc_id", "doc_id"), ("source", "source"), ("lang", "lang"), ("n_chars", n_chars), ("text", "text")]
    framed = [
        f"CASE WHEN {of} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"
        for of, value in fields
    ]
    return f"sha256({' || '.join(framed)})"


@query("op12_merkle_manifest", f"""
    WITH RECURSIVE crc_table AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], CAST(range(8) AS BIGINT[])),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ), d AS (
        SELECT row_number() OVER () AS row, doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
            coalesce(xor({_CRC}, 4294967295) % 7 = 0, false) AS tampered, {_leaf_sql('n_chars + 1')} AS other
        FROM documents, crc_table
    ), leaves AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size,
            CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree
        FROM d
    ), nodes AS (
        SELECT tree, 0 AS level, idx, leaf AS digest, size FROM leaves
        UNION ALL
        SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (size + 1) // 2
        FROM nodes WHERE size > 1 GROUP BY tree, level, idx // 2, size
    ), subroots AS (
        SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS size FROM nodes WHERE size = 1
    ), upper AS (
        SELECT 0 AS level, idx, subroot AS digest, size FROM subroots
        UNION ALL
        SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (size + 1) // 2
        FROM upper WHERE size > 1 GROUP BY level, idx // 2, size
    ), all_nodes AS (
        SELECT tree, level, idx, digest FROM nodes UNION ALL SELECT '/', level, idx, digest FROM upper
    ), walk AS (
        SELECT row, tree, tree AS name, 0 AS level, idx, size, CASE WHEN tampered THEN other ELSE leaf END AS own, '' AS proof FROM leaves
        UNION ALL
        SELECT w.row, CASE WHEN w.size = 1 THEN '/' ELSE w.tree END, w.name, CASE WHEN w.size = 1 THEN 0 ELSE w.level + 1 END,
            CASE WHEN w.size = 1 THEN s.idx ELSE w.idx // 2 END, CASE WHEN w.size = 1 THEN s.size ELSE (w.size + 1) // 2 END,
            CASE WHEN w.size = 1 THEN w.own WHEN b.digest IS NULL THEN sha256(w.own)
                WHEN w.idx % 2 = 1 THEN sha256(b.digest || w.own) ELSE sha256(w.own || b.digest) END,
            w.proof || CASE WHEN w.size = 1 THEN '' ELSE coalesce(b.digest, '') END
        FROM walk w JOIN subroots s ON s.tree = w.name
        LEFT JOIN all_nodes b ON b.tree = w.tree AND b.level = w.level AND b.idx = xor(w.idx, 1)
        WHERE w.size > 1 OR w.tree <> '/'
    )
    SELECT doc_id, leaf, subroot, u.digest AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = u.digest AS verified
    FROM walk w JOIN leaves USING (row) JOIN subroots s ON s.tree = w.name, (SELECT digest FROM upper WHERE size = 1) u
    WHERE w.tree = '/' AND w.size = 1
""")
def merkle_manifest(spark, folder):
    return merkle.report(table(spark, folder, "documents"), remainder(7) == 0)


@query("op13_quality_rules", r"""
    WITH d AS (
        SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), windows AS (
        SELECT row, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
    ), twice AS (
        SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS next
        FROM (SELECT row, i, count(*) OVER (PARTITION BY row, x) AS c FROM windows) WHERE c > 1
    ), covered AS (
        SELECT row, CAST(sum(least(8, coalesce(next - i, 8))) AS BIGINT) AS n FROM twice GROUP BY row
    ), m AS (
        SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
        FROM d LEFT JOIN covered USING (row)
    ), b AS (
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            word_chars < 2 * n_words OR word_chars > 15 * n_words OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR 4 * len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) > n_words
            OR 2 * len(regexp_extract_all(text, '[A-Z]')) > word_chars OR 5 * len(regexp_extract_all(text, '!')) > n_words
            OR 5 * len(regexp_extract_all(text, '[0-9]')) > word_chars
            OR 5 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[^\x21-\x40\x5B-\x60\x7B-\x7E]'))) > n_words AS other_failed
        FROM m
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT other_failed AS kept FROM b
""")
def quality_rules(spark, folder):
    return quality.report(table(spark, folder, "documents"))
