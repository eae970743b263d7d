"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, chunked_bpe, extract, mixing, negatives, neighbours, ogg, pitman_yor, simhash, suffix, toxicity, urlfilter, whitening
from ledgerline.llm.common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named_document() -> Column:
    """The document id in the path of a page's url; null where there is none."""
    number = F.regexp_extract(urlfilter.host_and_path(F.col("url"))[1], r"^/[a-z]+/([0-9]{1,18})", 1)
    return F.when(number != "", number.cast("long"))


def op1_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned outside fold 0."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages. A page's outcome is the label of the document that the number in its url names: bad if that
    document is toxic or of low quality."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    outcomes = (
        pages.select("page_id", _named_document().alias("doc_id"))
        .join(labels, "doc_id")
        .select("page_id", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    )
    return urlfilter.judge(pages, outcomes)


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as Ogg files and read back."""
    return ogg.read_media(ogg.write_media(_table(spark, sf_dir, "documents")))


def op4_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated passages."""
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learned outside fold 1."""
    return pitman_yor.score(_table(spark, sf_dir, "documents"))


def op7_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings, and the recall that an audit of them measures."""
    vectors = _table(spark, sf_dir, "embeddings")
    found = written(neighbours.near_duplicates(vectors))
    return found.withColumn("audit_recall", F.lit(neighbours.audit(vectors, found)))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "digest")


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages; the document that the number in a page's url names labels the page."""
    pages = _table(spark, sf_dir, "pages")
    chain = extract.fit(pages.withColumn("doc_id", _named_document()), _table(spark, sf_dir, "documents"))
    return extract.extract(pages, chain)


def op11_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors; every seventh takes part under the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened along the four leading eigenvectors of their covariance."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by ranks and decoded; long ones are pre-tokenised in overlapping chunks."""
    docs = _table(spark, sf_dir, "documents")
    return chunked_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "digest", public_tokenizers.PATTERN)


OP2_SQL = r"""
WITH r AS (SELECT page_id, coalesce(CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
known AS (SELECT page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
          FROM p JOIN labels l ON l.doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})', 1), '') AS BIGINT) GROUP BY 1),
h AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM p JOIN known USING (page_id) WHERE host <> '' GROUP BY 1, 2),
hp AS (SELECT *, string_split(bare, '.') AS parts FROM h),
hl AS (SELECT *, list_extract(parts, -1) AS l1, array_to_string(list_slice(parts, greatest(len(parts) - 1, 1), len(parts)), '.') AS l2, array_to_string(list_slice(parts, greatest(len(parts) - 2, 1), len(parts)), '.') AS l3, regexp_matches(bare, '^[0-9.]+$|^\[') AS address FROM hp),
hs AS (SELECT host, n, bad, CASE WHEN address THEN bare WHEN l2 IN (SUFFIXES) THEN l2 ELSE l1 END AS suffix, CASE WHEN address THEN bare WHEN l2 IN (SUFFIXES) THEN l3 ELSE l2 END AS domain FROM hl),
d AS (SELECT suffix, domain, sum(n) AS dn, sum(bad) AS db FROM hs GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS sn, sum(bad) AS sb FROM hs GROUP BY 1),
w AS (SELECT coalesce(sum(bad) / sum(n), 0.0) AS rate, CAST(coalesce(sum(n), 1) AS DOUBLE) AS most FROM hs),
v1 AS (SELECT sum((sb / sn - rate) * (sb / sn - rate) * sn) / sum(sn) - count(*) * max(rate) * (1 - max(rate)) / sum(sn) AS v FROM s, w WHERE sn > 1),
v2 AS (SELECT sum((db / dn - rate) * (db / dn - rate) * dn) / sum(dn) - count(*) * max(rate) * (1 - max(rate)) / sum(dn) AS v FROM d, w WHERE dn > 1),
v3 AS (SELECT sum((bad / n - rate) * (bad / n - rate) * n) / sum(n) - count(*) * max(rate) * (1 - max(rate)) / sum(n) AS v FROM hs, w WHERE n > 1),
m AS (SELECT rate, CASE WHEN v1.v > 0 THEN greatest(1.0, least(most, rate * (1 - rate) / v1.v - 1)) ELSE most END AS m1,
             CASE WHEN v2.v > 0 THEN greatest(1.0, least(most, rate * (1 - rate) / v2.v - 1)) ELSE most END AS m2,
             CASE WHEN v3.v > 0 THEN greatest(1.0, least(most, rate * (1 - rate) / v3.v - 1)) ELSE most END AS m3 FROM w, v1, v2, v3),
e AS (SELECT host, n, bad, m3, (db + m2 * ((sb + m1 * rate) / (sn + m1))) / (dn + m2) AS prior
      FROM hs JOIN d USING (suffix, domain) JOIN s USING (suffix), m),
ab AS (SELECT host, n, bad, greatest(bad + m3 * prior, 1e-6) AS a, greatest(n - bad + m3 * (1 - prior), 1e-6) AS b, ln(0.25 / 0.75) AS z FROM e),
g AS (SELECT *, ln(a / b) AS mid, least(z, ln(a / b) - 12 * sqrt(1 / a + 1 / b)) AS low, greatest(z, ln(a / b) + 12 * sqrt(1 / a + 1 / b)) AS high FROM ab),
x AS (SELECT host, n, bad, a, b, z, low, high, mid, unnest(range(0, 401)) AS k FROM g),
y AS (SELECT *, unnest([low + k * (z - low) / 400, z + k * (high - z) / 400]) AS v, unnest([(z - low) / 1200, (high - z) / 1200]) AS step, unnest([0, 1]) AS side, CASE WHEN k IN (0, 400) THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END AS weight FROM x),
f AS (SELECT *, exp(a * ((CASE WHEN v > 0 THEN -ln(1 + exp(-v)) ELSE v - ln(1 + exp(v)) END) - (CASE WHEN mid > 0 THEN -ln(1 + exp(-mid)) ELSE mid - ln(1 + exp(mid)) END)) + b * ((CASE WHEN (-v) > 0 THEN -ln(1 + exp(-(-v))) ELSE (-v) - ln(1 + exp((-v))) END) - (CASE WHEN (-mid) > 0 THEN -ln(1 + exp(-(-mid))) ELSE (-mid) - ln(1 + exp((-mid))) END))) AS density FROM y),
q AS (SELECT host, n, bad, sum(density * weight * step + CASE WHEN side = 1 AND k = 400 THEN density / b ELSE 0 END) FILTER (side = 1) AS more, sum(density * weight * step + CASE WHEN side = 0 AND k = 0 THEN density / a ELSE 0 END) FILTER (side = 0) AS less FROM f GROUP BY 1, 2, 3),
b AS (SELECT host, n, bad, more / (more + less) AS bound FROM q),
j AS (SELECT page_id, p.host, path, n, bad, bound,
      CASE WHEN (p.host = 'example.org' OR p.host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
           WHEN (p.host = 'example.org' OR p.host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
           WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
           WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
           WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM p LEFT JOIN b ON b.host = p.host)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.95 THEN 'block' ELSE 'allow' END AS verdict,
       CAST(coalesce(n, 0) AS BIGINT) AS host_pages, CAST(coalesce(bad, 0) AS BIGINT) AS host_bad
FROM j
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in urlfilter.TWO_LABEL_SUFFIXES))

OP9_SQL = r"""
WITH z AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM t),
w AS (SELECT *, [5, 2, 1][CAST(rank % 3 + 1 AS BIGINT)] AS weight, source_size * CAST(2.0 AS DOUBLE) AS cap_size FROM r),
f AS (SELECT *, cap_size / weight AS ratio FROM w),
c AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
        - coalesce(sum(cap_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS candidate FROM f),
l AS (SELECT arg_min(candidate, (ratio, rank)) AS level FROM c WHERE candidate <= ratio),
g AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap_size ELSE least(cap_size, weight * level) END AS target FROM c, l),
p AS (SELECT z.doc_id, z.size, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS whole,
             CAST(coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY place, z.size, z.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, whole - start)) + greatest(0, least(size, whole - start - source_size)) AS taken
FROM p
"""


OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity_nnpu, op2_url_reputation, op3_ogg_media, op4_simhash_vptree, op5_deep_shallow, op6_pitman_yor, op7_pruned_graph, op8_bpe_automaton, op9_curriculum_mix, op10_crf_extraction, op11_anchor_tree_negatives, op12_jacobi_davidson, op13_chunked_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_reputation": OP2_SQL, "op9_curriculum_mix": OP9_SQL, "op11_anchor_tree_negatives": OP11_SQL}
