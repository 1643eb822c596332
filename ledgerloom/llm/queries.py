"""One query for each corpus operator, with production parameters and whole tables, and the SQL it is compared with."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import small_batches
from ledgerloom.llm.decontaminate import contamination_digest
from ledgerloom.llm.embedding_dedup import embedding_groups
from ledgerloom.llm.langid import identify_held_out
from ledgerloom.llm.line_dedup import line_digest
from ledgerloom.llm.secrets import secret_digest
from ledgerloom.llm.sentencepiece_ops import piece_digest
from ledgerloom.llm.simhash import simhash_digest
from ledgerloom.llm.substring_dedup import substring_dedup
from ledgerloom.llm.token_files import token_round_trip
from ledgerloom.llm.toxicity import toxicity_held_out


def vocabulary(name: str) -> str:
    """A public tokenizer's file; LEDGERLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("LEDGERLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark, sf_dir):
    return embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_language_id(spark, sf_dir):
    return identify_held_out(table(spark, sf_dir, "documents"), modulus=3, remainder=1)


def op3_line_dedup(spark, sf_dir):
    return line_digest(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash_digest(table(spark, sf_dir, "documents"), size=3, radius=2, seed=42)


def op5_toxicity(spark, sf_dir):
    return toxicity_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"), size=13)


def op7_decontamination(spark, sf_dir):
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13, one_in=20)


def op8_secret_scan(spark, sf_dir):
    return secret_digest(table(spark, sf_dir, "documents"))


def op9_token_files(spark, sf_dir):
    return token_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op10_sentencepiece(spark, sf_dir):
    return piece_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_language_id,
        op3_line_dedup,
        op4_simhash_near_dedup,
        op5_toxicity,
        op6_substring_dedup,
        op7_decontamination,
        op8_secret_scan,
        op9_token_files,
        op10_sentencepiece,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES_SQL = f"""
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM {{docs}}),
keyed AS (SELECT *, translate(trim(line, {_TRIM}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)"""

ORACLES = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON pairs.a = reach.b),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op3_line_dedup": f"""
WITH {LINES_SQL.format(docs="documents")},
marked AS (SELECT keyed.*, common.k IS NOT NULL AS dropped FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_substring_dedup": r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN firsts USING (win), range(0, 13) t(j) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
kept AS (SELECT words.doc_id, words.word, words.p, gone.p IS NOT NULL AS removed
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p),
agg AS (SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT removed) AS t FROM kept GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN agg USING (doc_id)""",
    "op7_decontamination": rf"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
pat AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS win
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM pat),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
win AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT win.doc_id, win.i, win.n, pat.item_id FROM win JOIN pat ON pat.win = win.win AND pat.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM occ, range(0, 13) t(j) WHERE j < n GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM occ GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
