"""The queries over the driver's tables: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm.common import crc_mod, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mih_sign_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every hundredth embedding."""
    from keepstone.llm.op1_mih import nearest_codes, sign_code

    rows = table(spark, sf_dir, "embeddings").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    return nearest_codes(spark, rows, F.col("vec_id") % 100 == 0)


def op2_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm import op2_language

    docs = table(spark, sf_dir, "documents")
    part = crc_mod("doc_id", 4)
    model = op2_language.fit(docs, part != 2)
    docs = docs.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "text")
    return op2_language.predict(docs, model, ["doc_id", "held_out"])


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm.op3_permutation import nearest

    return nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm.op4_huffman import huffman_round_trip

    return huffman_round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op5_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm.op5_licenses import scan_documents

    return scan_documents(table(spark, sf_dir, "documents")).drop("spans")


def op6_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm.op6_sentencepiece import encode_documents

    docs = table(spark, sf_dir, "documents")
    return encode_documents(spark, docs, tokenizer_path("piece_bpe_32k.model")).drop("ids")


def op7_fm_index_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm.op7_substring import remove_repeats

    return remove_repeats(spark, table(spark, sf_dir, "documents"))


def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm.op8_simhash import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm import op9_quality

    docs = table(spark, sf_dir, "documents")
    part = crc_mod("doc_id", 5)
    model = op9_quality.fit(docs, table(spark, sf_dir, "labels"), part != 0)
    docs = docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text")
    return op9_quality.score(docs, model, ["doc_id", "held_out"])


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm.op10_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm.op11_filter_audit import audit

    return audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_delta_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm.op12_delta_lloyd import vector_codes

    return vector_codes(spark, table(spark, sf_dir, "embeddings"))


def op13_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.llm import op13_toxicity

    docs = table(spark, sf_dir, "documents")
    part = crc_mod("doc_id", 5)
    model = op13_toxicity.fit(docs, table(spark, sf_dir, "labels"), part != 0)
    docs = docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text")
    return op13_toxicity.score(docs, model, ["doc_id", "held_out"])


OP1_SQL = """
WITH codes AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        len(list_filter(list_zip(q.bits, c.bits), lambda p: p[1] != p[2])) AS distance
    FROM codes q JOIN codes c ON q.vec_id % 100 = 0 AND c.vec_id != q.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance
FROM ranked WHERE rank <= 10
"""


OP7_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS j, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i + 49], ' '))) AS k FROM d WHERE len(w) >= 50),
first AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
hit AS (SELECT doc_id, j FROM windows JOIN first USING (k) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS j FROM d WHERE doc_id IN (SELECT doc_id FROM hit)),
marked AS (SELECT x.doc_id, x.j, x.w, coalesce(max(CASE WHEN h.j IS NOT NULL THEN 1 END) OVER (PARTITION BY x.doc_id ORDER BY x.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
    FROM words x LEFT JOIN hit h ON h.doc_id = x.doc_id AND h.j = x.j),
kept AS (SELECT doc_id, count(*) FILTER (gone = 1) AS n_removed, string_agg(w, ' ' ORDER BY j) FILTER (gone = 0) AS k FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(CASE WHEN n_removed IS NULL THEN array_to_string(w, ' ') ELSE coalesce(k, '') END) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP11_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
facts AS (
    SELECT d.doc_id, part,
        [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 3 * length(d.t),
            regexp_matches(d.t, '[#$%&*|]'), coalesce(d.doc_id > least, false)] AS fails,
        coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
        coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
    FROM d JOIN least USING (t)
), masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM facts GROUP BY part, fails),
letters AS (SELECT unnest(range(1, 6)) AS f),
orders AS (
    SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT o, array_to_string(list_transform(o, lambda f: chr((64 + f)::INT)), '') AS filter_order, step, o[step] AS f FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
    SELECT part, filter_order, step, any_value(f) AS f,
        coalesce(sum(n) FILTER (gone = 0 OR gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed,
        coalesce(sum(n) FILTER (fails[f] AND gone < step AND gone > 0), 0) AS redundant,
        coalesce(sum(n) FILTER (fails[f] AND len(list_filter(fails, lambda x: x)) = 1), 0) AS unique_fails,
        coalesce(sum(good) FILTER (gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
    FROM (SELECT m.*, s.*, coalesce(list_position(list_transform(o, lambda f: fails[f]), true), 0) AS gone FROM masks m, steps s)
    GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


def op12_sql(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """Plain Lloyd rounds, one after the other, over all parts of all vectors."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (SELECT id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (
    SELECT p, e, x AS c FROM parts JOIN (SELECT id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}) USING (id)
)"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (
    SELECT id, p, x, arg_min({{'e': e, 'far': far}}, {{'far': far, 'e': e}}) AS best
    FROM (SELECT id, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM parts JOIN book{k} USING (p))
    GROUP BY id, p, x
)"""
        )
        if k < rounds:
            steps.append(
                f"""mean{k} AS (
    SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c
    FROM (SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY ALL)
    GROUP BY p, e
), book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""
            )
    last = f"""coded AS (
    SELECT id, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY p) AS code, sum(best.far)::BIGINT AS error FROM near{rounds} GROUP BY id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY p, e) FROM book{rounds})) AS codebooks_sha256
FROM coded JOIN kept USING (id)"""
    return ", ".join([*steps, last])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_mih_sign_codes,
            op2_byte_gru_language,
            op3_permutation_index,
            op4_huffman_files,
            op5_license_automaton,
            op6_sentencepiece_scan,
            op7_fm_index_substrings,
            op8_simhash_pivots,
            op9_attention_quality,
            op10_harmonic_packing,
            op11_filter_audit,
            op12_delta_lloyd_codes,
            op13_weak_toxicity,
        )
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express on whole tables."""
    return {"op1_mih_sign_codes": OP1_SQL, "op7_fm_index_substrings": OP7_SQL, "op11_filter_audit": OP11_SQL, "op12_delta_lloyd_codes": op12_sql()}
