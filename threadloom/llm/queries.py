"""The registered queries of the training-data operators, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, divergence, interactions, licenses, packing, quality, secrets, sharding, simhash, suffix_dedup, tokens, vectors, warc
from threadloom.llm.common import table


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dims = {"lang": F.crc32("lang"), "source": F.crc32("source"), "length": F.log1p(F.coalesce(F.col("n_chars"), F.lit(0)).cast("double")), "arrival": F.col("doc_id")}
    placed = sharding.shard(docs, dims, leaves=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), 50).drop("kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 2048)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 0.8, ["doc_id"])
    return marked.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings"), 0.9)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(table(spark, sf_dir, "documents")))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), 3, 2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_kd_shards, op2_suffix_dedup, op3_best_fit_packing, op4_decontaminate, op5_warc_index, op6_cap_filters, op7_secret_scan, op8_simhash_groups, op9_quality, op10_license_scan, op11_token_counts, op12_source_divergence, op13_filter_interactions)}


def _kind_sql(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"SELECT doc_id, owner, {number} AS no, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{quoted}', 0) AS hit, regexp_extract_all(t, '{quoted}', {group}) AS sec, string_split_regex(t, '{quoted}') AS gap FROM d"


_EITHER = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = " UNION ALL ".join([_kind_sql(0, "assign", _EITHER, 2, 12), _kind_sql(1, "access", "AKIA[A-Z0-9]+", 0, 18), _kind_sql(2, "hex", "[0-9a-f]+", 0, 16), _kind_sql(3, "live", "[A-Za-z0-9+/_-]{24,}", 0, 24)])

ORACLE_SQL: dict[str, str] = {
    "op5_warc_index": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
      f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
      SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d LEFT JOIN f USING (h)""",
    "op6_cap_filters": """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
      r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
      c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
      SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op7_secret_scan": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents), k AS ({_KINDS}),
      x AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM k WHERE len(hit) > 0),
      y AS (SELECT doc_id, owner, no, kind, sec[i] AS sec, length(hit[i]) AS n, coalesce(list_sum(list_transform(gap[1:i], lambda g: length(g))), 0)::BIGINT + coalesce(list_sum(list_transform(hit[1:i - 1], lambda g: length(g))), 0)::BIGINT AS s FROM x WHERE length(sec[i]) >= least),
      b AS (SELECT * FROM y WHERE no < 3), m AS (SELECT * FROM y WHERE no = 3 AND regexp_matches(sec, '[0-9]') AND regexp_matches(sec, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = y.doc_id AND b.s < y.s + y.n AND y.s < b.s + b.n)),
      u AS (FROM b UNION ALL FROM m), o AS (SELECT sec, count(DISTINCT owner) <= 1 AND count(DISTINCT (owner, doc_id)) <= 3 AS few FROM u GROUP BY sec),
      w AS (SELECT u.*, few FROM u JOIN o USING (sec) WHERE no < 3 OR few),
      g AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex, count(*) FILTER (no = 3) AS n_live, count(*) FILTER (no < 3 AND NOT few) AS n_copied,
        string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, no) AS spans FROM w GROUP BY doc_id)
      SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)""",
    "op12_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
      t AS (SELECT i, lang, source, unnest(w) AS term FROM d), c AS (SELECT i, lang, source, term, count(*) AS n FROM t GROUP BY ALL),
      kept AS (SELECT lang, term FROM c GROUP BY 1, 2 HAVING count(*) >= 30), o AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM c SEMI JOIN kept USING (lang, term) GROUP BY ALL),
      v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1), g AS (SELECT DISTINCT lang, source FROM d),
      gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN o USING (lang, source) GROUP BY ALL),
      p AS (SELECT gn.lang, gn.source, kept.term, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (total + 5 * v) AS p FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN o ON o.lang = gn.lang AND o.source = gn.source AND o.term = kept.term),
      l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM o GROUP BY ALL), ln AS (SELECT lang, sum(n)::HUGEINT AS total FROM l GROUP BY 1), q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q FROM l JOIN ln USING (lang) JOIN v USING (lang)),
      s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
      pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
      tr AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
      r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pr UNION ALL FROM tr))
      SELECT * FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_filter_interactions": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
      lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
      m AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN lab USING (doc_id)),
      c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
      o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5), s AS (SELECT o, unnest(range(1, 6))::INTEGER AS step FROM o),
      x AS (SELECT part, o AS filter_order, step, o[step] AS own, c.*, NOT regexp_matches(fails, '[' || o[1:step] || ']') AS stays, step = 1 OR NOT regexp_matches(fails, '[' || o[1:greatest(step - 1, 1)] || ']') AS here, contains(fails, o[step]) AS bad FROM s, c),
      y AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (stays), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND bad), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (bad AND NOT here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (here AND bad), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND bad), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
      SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM y""",
}
