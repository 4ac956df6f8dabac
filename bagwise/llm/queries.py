"""Registered queries of the corpus operators, and their DuckDB statements.

Each query applies its operator to the whole ``documents`` table and derives
the digest columns from the operator's own result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.llm import (alignment, exact_dedup, fill_in_middle, mixing, near_dedup, packing, pii, quality_model,
                         quality_rules, secret_scan, sharding, substring_dedup, topk_search)

SHARDS = 8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> packing.Vocabulary:
    import public_tokenizers as files
    return packing.Vocabulary(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def tokenizers() -> alignment.Tokenizers:
    import public_tokenizers as files
    return alignment.Tokenizers(files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"),
                                files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op3_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(documents(spark, sf_dir))


def op5_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), SHARDS)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op8_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op2_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir))


def op9_weak_label_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def op4_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir), words=4, per_cent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_relative_lz_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(documents(spark, sf_dir))


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_report(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(back, 256).alias("restored_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(documents(spark, sf_dir), tokenizers())


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


REGISTRY = {
    "op1_sum_of_squares_packing": op1_sum_of_squares_packing,
    "op2_secret_randomness": op2_secret_randomness,
    "op3_chunk_recipes": op3_chunk_recipes,
    "op4_setsketch_near_dedup": op4_setsketch_near_dedup,
    "op5_jump_hash_shards": op5_jump_hash_shards,
    "op6_source_mix": op6_source_mix,
    "op7_relative_lz_spans": op7_relative_lz_spans,
    "op8_adaptive_quality_rules": op8_adaptive_quality_rules,
    "op9_weak_label_pii": op9_weak_label_pii,
    "op10_weak_label_quality": op10_weak_label_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_exact_top_k": op13_exact_top_k,
}

WORDS = "list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '')"

#: The rules of op8 with its sketches, bin by bin.
OP8_MEASURES = {"symbols_per_word": "n_symbols / greatest(n_words, 1)",
                "dup_lines_per_line": "n_dup_lines / greatest(n_lines, 1)",
                "chars_per_word": "word_chars / greatest(n_words, 1)"}


def _op8_sql() -> str:
    q = quality_rules
    values = " UNION ALL ".join(f"SELECT rid, lang, source, '{m}' AS m, {e} AS v FROM b" for m, e in OP8_MEASURES.items())
    spread = "CASE m " + " ".join(f"WHEN '{m}' THEN {x[2]}" for m, x in q.MEASURES.items()) + " END"
    lower = ", ".join(f"'{m}'" for m, x in q.MEASURES.items() if x[3])

    def level(name: str, by: str, parent: str, parent_by: str) -> str:
        keys = [k.strip() for k in by.split(",")]
        on = " AND ".join(f"g.{k.strip()} IS NOT DISTINCT FROM p.{k.strip()}" for k in parent_by.split(","))
        return f"""
            {name} AS (SELECT {by}, bin, sum(n) AS n FROM (
                SELECT {by}, bin, count(*)::DOUBLE AS n FROM v WHERE n_words > 0 GROUP BY {by}, bin
                UNION ALL
                SELECT {", ".join("g." + k for k in keys)}, p.bin, {q.PRIOR_ROWS} * p.n / p.total
                FROM (SELECT DISTINCT {by} FROM v WHERE n_words > 0) g
                JOIN (SELECT *, sum(n) OVER (PARTITION BY {parent_by}) AS total FROM {parent}) p ON {on})
                GROUP BY {by}, bin)"""

    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, {WORDS} AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
        win AS (SELECT rid, i, list_slice(ws, i, i + {q.WINDOW - 1}) AS k
                FROM (SELECT rid, ws, unnest(range(1, len(ws) - {q.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {q.WINDOW})),
        rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
        cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {q.WINDOW})) AS p FROM rep) GROUP BY rid),
        b AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words,
                     length(regexp_replace(t, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                     coalesce(cov.n, 0)::BIGINT AS n_repeat_words
              FROM w LEFT JOIN cov USING (rid)),
        v AS (SELECT x.*, n_words, CASE WHEN v <= {q.SMALLEST} THEN 0
                     ELSE floor(ln(v / {q.SMALLEST}) / ln({q.RESOLUTION})) + 1 END AS bin
              FROM ({values}) x JOIN b USING (rid)),
        every AS (SELECT m, bin, count(*)::DOUBLE AS n FROM v WHERE n_words > 0 GROUP BY m, bin),
        {level("langs", "lang, m", "every", "m")}, {level("own", "lang, source, m", "langs", "lang, m")},
        f AS (SELECT lang, source, m, min(CASE WHEN c + {q.SLACK} >= 0.25 * n THEN edge END) AS q25,
                     min(CASE WHEN c + {q.SLACK} >= 0.75 * n THEN edge END) AS q75
              FROM (SELECT lang, source, m, CASE WHEN bin = 0 THEN 0 ELSE {q.SMALLEST} * pow({q.RESOLUTION}, bin) END AS edge,
                           sum(n) OVER (PARTITION BY lang, source, m ORDER BY bin) AS c,
                           sum(n) OVER (PARTITION BY lang, source, m) AS n
                    FROM own) GROUP BY lang, source, m),
        g AS (SELECT lang, source, m, q75 + {q.REACH} * greatest(q75 - q25, {spread}) AS high,
                     CASE WHEN m IN ({lower}) THEN q25 - {q.REACH} * greatest(q75 - q25, {spread}) ELSE -1 END AS low FROM f),
        bad AS (SELECT rid, string_agg(v.m, ',' ORDER BY list_position({list(q.MEASURES)}, v.m)) AS failed
                FROM v JOIN g ON v.lang IS NOT DISTINCT FROM g.lang AND v.source IS NOT DISTINCT FROM g.source AND v.m = g.m
                WHERE v > high OR v < low GROUP BY rid)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND failed IS NULL AS kept,
               coalesce(failed, '') AS failed
        FROM b LEFT JOIN bad USING (rid)"""


OP4 = f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT rid, doc_id, {WORDS} AS ws FROM d),
    s AS (SELECT DISTINCT rid, list_slice(ws, i, i + 3) AS g
          FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
    l AS (SELECT x, y FROM c JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
    r AS (SELECT rid AS x, rid AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
    m AS (SELECT r.x AS rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.y GROUP BY r.x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM w JOIN m USING (rid) LEFT JOIN n USING (rid)"""

OP7 = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, doc_id, {WORDS} AS ws FROM d),
    win AS (SELECT rid, doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS k
            FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
    dup AS (SELECT rid, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
    gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM dup),
    each AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
    kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
             FROM each ANTI JOIN gone USING (rid, p) GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(text, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (rid)"""

OP11 = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                      sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    c AS (SELECT *, len(u) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS hs FROM d),
    k AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 100
                      THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
    p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y,
                 array_to_string(u[b + 1:n], '') AS z FROM k)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(y)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
                  ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
    FROM p"""

OP13 = """
    WITH v AS (SELECT row_number() OVER () AS rid, vec_id,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
               FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(
                    embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

ORACLE = {
    "op11_fill_in_middle": OP11,
    "op13_exact_top_k": OP13,
    "op4_setsketch_near_dedup": OP4,
    "op7_relative_lz_spans": OP7,
    "op8_adaptive_quality_rules": _op8_sql(),
    "op3_chunk_recipes": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
