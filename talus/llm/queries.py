"""The numbered queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import collocations, embedding_dedup, html_text, license_scan, line_dedup, mixing, packing, periodic_runs, quality_mil, quality_rules, simhash, substring_dedup, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), packing.SEQUENCE).withColumnRenamed("id", "doc_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_read(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_read(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their sources: source/language/doc_id.txt."""
    docs = _read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    out = license_scan.scan_licenses(docs.select(path.alias("path"), "doc_id", "text"), id_col="doc_id")
    return out.select(F.col("id").alias("doc_id"), "path", "license", "score", "is_license_file", "origin", "inherited_from")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_mil.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", "held_out", "score", "predicted", "n_passages", "top_passage", "top_weight")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, "compressed_share", "n_chunks", "n_stray_chunks", "verdict")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents"), window=13)
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(_read(spark, sf_dir, "embeddings"), 0.9).withColumnRenamed("id", "vec_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(_read(spark, sf_dir, "documents"))


def op12_digest(docs: DataFrame) -> DataFrame:
    runs = periodic_runs.collapse_runs(docs, alter=periodic_runs.periodic_tenth).withColumn("best", periodic_runs.longest_by_exponent(F.col("runs")))
    return runs.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_digest(_read(spark, sf_dir, "documents"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.fit_urls(url_filter.labelled_urls(spark), label="label")
    out = url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), weights)
    return out.select("page_id", "host", "path", "rule", "verdict", "block_ppm")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_url_filters": op13_url_filters,
}

ORACLE_SQL: dict[str, str] = {
    "op4_source_mixing": """
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), shares AS (
  SELECT source, n, pow(n, 0.7) AS weight, sum(pow(n, 0.7)) OVER () AS total,
         round(pow(n, 0.7) / sum(pow(n, 0.7)) OVER () * 1000, 6) AS share FROM sizes
), usable AS (
  SELECT source, false AS small, share FROM shares WHERE share >= 1
  UNION ALL
  SELECT NULL, true, greatest(round(sum(share), 6), 1) FROM shares WHERE share < 1 HAVING count(*) > 0
), floors AS (
  SELECT source, small, floor(share)::BIGINT AS whole,
         row_number() OVER (ORDER BY round(share - floor(share), 6) DESC, small, source ASC NULLS FIRST) AS place,
         1000 - sum(floor(share)::BIGINT) OVER () AS missing
  FROM usable
), parts AS (
  SELECT source, small, whole + CASE WHEN place <= missing THEN 1 ELSE 0 END AS parts FROM floors
), used AS (
  SELECT source, small, parts, row_number() OVER (ORDER BY coalesce(source, ''), small, source ASC NULLS FIRST) AS i FROM parts WHERE parts > 0
), lists AS (
  SELECT list(parts ORDER BY i) AS q FROM used
), edf AS (
  SELECT -1 AS slot, list_transform(q, lambda x: 0::BIGINT) AS placed, 0::BIGINT AS best, q FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(placed, lambda x, i: x + CASE WHEN i = b THEN 1 ELSE 0 END), b, q
  FROM (
    SELECT slot, placed, q, list_min(list_filter(list_transform(q, lambda p, i: {'d': CASE
             WHEN placed[i] < p AND (placed[i] * 1000) // p <= slot + 1
             THEN ((placed[i] + 1) * 1000 + p - 1) // p END, 'i': i}), lambda s: s.d IS NOT NULL)).i AS b
    FROM edf WHERE slot < 999
  )
), pattern AS (
  SELECT u.source, u.small, u.parts, e.placed[u.i] - 1 AS k, e.slot AS at FROM edf e JOIN used u ON e.best = u.i WHERE e.slot >= 0
), small_blocks AS (
  SELECT source, weight, total, unnest(range((n + 15) // 16)) AS block FROM shares WHERE share < 1
), small_places AS (
  SELECT *, row_number() OVER (ORDER BY (block + 1) / weight, source ASC NULLS FIRST, block) - 1 AS place FROM small_blocks
), blocks AS (
  SELECT z.source, b.block, (b.block // p.parts * 1000 + p.at)::BIGINT AS slot, (b.block * 1000 // p.parts)::BIGINT AS release,
         (((b.block + 1) * 1000 + p.parts - 1) // p.parts)::BIGINT AS deadline
  FROM sizes z, unnest(range((z.n + 15) // 16)) AS b(block)
  JOIN pattern p ON NOT p.small AND z.source IS NOT DISTINCT FROM p.source AND b.block % p.parts = p.k
  UNION ALL
  SELECT s.source, s.block, (s.place // p.parts * 1000 + p.at)::BIGINT, floor(s.block * (total / weight))::BIGINT, ceil((s.block + 1) * (total / weight))::BIGINT
  FROM small_places s JOIN pattern p ON p.small AND s.place % p.parts = p.k
), ends AS (
  SELECT min(h) AS horizon FROM (
    SELECT ((z.n + 15) // 16) // p.parts * 1000 + p.at AS h
    FROM sizes z JOIN pattern p ON NOT p.small AND z.source IS NOT DISTINCT FROM p.source AND ((z.n + 15) // 16) % p.parts = p.k
    UNION ALL
    SELECT s.n // p.parts * 1000 + p.at FROM (SELECT count(*) AS n FROM small_blocks) s JOIN pattern p ON p.small AND s.n % p.parts = p.k
  )
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR) NULLS FIRST, doc_id) - 1 AS rank FROM documents
)
SELECT r.doc_id, r.source, (r.rank // 16)::BIGINT AS block, b.slot, b.release, b.deadline,
       (b.slot * 16 + r.rank % 16)::BIGINT AS position, coalesce(b.slot < e.horizon, false) AS in_mix
FROM ranked r LEFT JOIN blocks b ON r.source IS NOT DISTINCT FROM b.source AND r.rank // 16 = b.block, ends e""",
    "op8_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w
), k AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k FROM s
), f AS (
  SELECT k, min(doc_id) AS first_doc FROM k GROUP BY k
), gone AS (
  SELECT DISTINCT k.doc_id, k.i + unnest(range(0, 13)) AS p FROM k JOIN f ON k.k = f.k WHERE f.first_doc < k.doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS t, count(*) AS n FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p
  WHERE g.p IS NULL GROUP BY a.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op9_embedding_near_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM good
), e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) >= 0.9
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT m.vec_id, (SELECT count(*) FROM e WHERE e.x = m.vec_id)::BIGINT AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON m.vec_id = c.x""",
    "op10_line_dedup": """
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts
), keys AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keys WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(f.first_doc < k.doc_id, false) AS gone
  FROM keys k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), grams AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) t(m))
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100
), cuts AS (
  SELECT lang, m, phrase, f, unnest(range(1, m)) AS k FROM f WHERE m > 1
), parts AS (
  SELECT *, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail FROM cuts
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.f AS a, min({'score': ((1000::HUGEINT * c.f * t.n) // (h.f::HUGEINT * r.f))::BIGINT, 'k': c.k, 'l': h.f, 'r': r.f, 'n': t.n}) AS cut
  FROM parts c JOIN f h ON c.lang = h.lang AND c.head = h.phrase JOIN f r ON c.lang = r.lang AND c.tail = r.phrase JOIN totals t ON c.lang = t.lang
  GROUP BY ALL
), inner_ AS (
  SELECT lang, a, size, phrase, unnest(range(1, m - size + 2)) AS i FROM scored, range(2, 5) t(size) WHERE size < m
), held AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + size - 1], ' ') AS phrase, max(a) AS around FROM inner_ GROUP BY ALL
), ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.cut.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.cut.l AS l, s.cut.r AS r, s.cut.n AS n, s.cut.score AS score
  FROM scored s LEFT JOIN held h ON s.lang = h.lang AND s.phrase = h.phrase WHERE h.around IS NULL OR 100 * h.around < 100 * s.a
)
SELECT * FROM ranked WHERE rank <= 2000""",
    "op13_url_filters": url_filter.filter_sql(url_filter.labelled_rows()),
}
