"""One production query per training-data operator, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pluvio.llm import (
    bpe, exact_dedup, hard_negatives, licenses, minhash, ngram_join, packing, periodic_runs, quality, substring, token_counts,
    token_matrix, url_filter,
)
from pluvio.llm.common import load
from pluvio.plans.registry import query

_WORD = "[^\\x20\\x09-\\x0D]+"


@query(
    "op1_quality_rules",
    "",
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
    grams AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
    m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                 CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
                 len(ls) AS n_lines, len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS n_shouted,
                 len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stuttered
          FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 50 * n_lines
                OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_shouted > 25 * n_words
                OR 100 * n_stuttered > 30 * n_words) AS kept
    FROM b
    """,
)
def op1_quality_rules(spark, sf):
    """Measures and verdict of the quality cascade for every document."""
    return quality.quality_report(load(spark, sf, "documents"))


@query("op3_byte_bpe", "")
def op3_byte_bpe(spark, sf):
    """Every document encoded by the multilingual byte-level ranks and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.decode(bpe.encode(load(spark, sf, "documents"), path), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_concatenate_and_cut", "")
def op4_concatenate_and_cut(spark, sf):
    """All documents in one stream of ids, cut into windows of 2048."""
    pieces = packing.pack(load(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query(
    "op5_exact_dedup",
    "",
    r"""
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           row_number() OVER (PARTITION BY n ORDER BY doc_id) = 1 AS kept, sha256(n) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
    WINDOW g AS (PARTITION BY n)
    """,
)
def op5_exact_dedup(spark, sf):
    """The group of equal normalised texts of every document."""
    return exact_dedup.exact_groups(load(spark, sf, "documents"))


@query("op7_token_matrices", "")
def op7_token_matrices(spark, sf):
    """All documents in packed id matrices of width 2048; one row per matrix row."""
    packed = token_matrix.pack_matrices(load(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, end_id=1)
    return packed.select(
        "shard", "row", "n_tokens", "doc_ids", "starts", "cu_seqlens",
        F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"),
    )


@query("op8_token_counts", "")
def op8_token_counts(spark, sf):
    """Token counts of every document by the compiled transducer."""
    return token_counts.token_counts(load(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


#: The production rules: host and path prefix, verdict.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def _fits(rule: str) -> str:
    host, path = rule.split("/", 1)
    return f"(('.' || host) LIKE '%.{host}' AND starts_with(path, '/{path}'))"


@query(
    "op9_url_rules",
    "",
    f"""
    WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM r),
    v AS (SELECT *, CASE {' '.join(f"WHEN {_fits(rule)} THEN '{rule}'" for rule, _ in sorted(URL_RULES, key=lambda x: -len(x[0])))} END AS rule FROM h)
    SELECT page_id, host, path, rule,
           CASE {' '.join(f"WHEN rule = '{rule}' THEN '{verdict}'" for rule, verdict in URL_RULES)} ELSE 'allow' END AS verdict FROM v
    """,
)
def op9_url_rules(spark, sf):
    """Host, path, rule and verdict of every page."""
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in URL_RULES])))
    return url_filter.judge_urls(load(spark, sf, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op10_ngram_jaccard", "")
def op10_ngram_jaccard(spark, sf):
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.similar_components(load(spark, sf, "documents"), shingle_words=3, num=90, den=100)


@query("op6_substring_dedup", "")
def op6_substring_dedup(spark, sf):
    """Passages that repeat within or across documents, every occurrence, the first one marked kept."""
    return substring.repeated_spans(load(spark, sf, "documents"))


@query("op2_license_scan", "")
def op2_license_scan(spark, sf):
    """License notices in the documents, with what compression saves and how the wording differs."""
    return licenses.license_blocks(load(spark, sf, "documents")).drop("block")


def with_planted_periods(docs):
    """``docs``, a tenth of the texts (by the checksum of doc_id) made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))

    def periodic(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda j: F.get(w, a + j % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), tail), " "))

    # the words are bound once: a lambda over a one-element array
    planted = F.coalesce(F.get(F.transform(F.array(words), periodic), F.lit(0)), F.lit(""))
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), planted).otherwise(F.col("text")))


@query("op11_periodic_runs", "")
def op11_periodic_runs(spark, sf):
    """Periodic runs of words in every document, the strongest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs.periodic_runs(with_planted_periods(load(spark, sf, "documents")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # runs come by start, then period: the first of the greatest exponents stays
    top = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op12_minhash_dedup",
    "",
    rf"""
    WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
          FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
    c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN c ca ON a = ca.doc_id JOIN c cb ON b = cb.doc_id WHERE 100 * k >= 85 * (ca.n + cb.n - k)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach(node, low) AS (SELECT a, b FROM e WHERE b < a UNION SELECT e.a, r.low FROM reach r JOIN e ON e.b = r.node WHERE r.low < e.a),
    m AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
    SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.low, w.doc_id) AS component_id, m.low IS NULL AS kept
    FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN m ON m.node = w.doc_id
    """,
)
def op12_minhash_dedup(spark, sf):
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return minhash.similar_components(load(spark, sf, "documents"), shingle_words=5, num=85, den=100)


@query(
    "op13_hard_negatives",
    "",
    """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                 CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
          WHERE 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
)
def op13_hard_negatives(spark, sf):
    """Up to five hard negatives for each of the first five positives of every hundredth vector."""
    rows = load(spark, sf, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query("pipeline", "")
def pipeline(spark, sf):
    """The corpus pipeline of ``corpus_pipeline.py`` over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
