"""Queries and SQL of this subpackage, for the driver's entry point."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_util import small_batches

#: The block list of op10, a parameter: domains that are blocked with all their subdomains.
LISTED = tuple(f"{name}.example.{end}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))
RULES = {"block": [("net", "/"), ("example.com", "/de/")], "allow": [("example.net", "/en/"), ("org", "/fr/")]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "documents":
        small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_nn_descent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import dedup

    return dedup(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), 0.98)


def embedding_links_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's operator over the table and near copies of two fifths of it, in groups of up to three: links that SQL can count."""
    from .embed_dedup import dedup

    v = _table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    bent = lambda by: F.transform("embedding", lambda x, i: (x.cast("double") * (1 + by * (i % 2))).cast("float"))
    copies = v.filter("vec_id % 5 < 2").select((F.col("vec_id") + 10_000_000).alias("vec_id"), "label", bent(0.05).alias("embedding"))
    more = v.filter("vec_id % 5 = 0").select((F.col("vec_id") + 20_000_000).alias("vec_id"), "label", bent(0.3).alias("embedding"))
    return dedup(v.unionByName(copies).unionByName(more), 0.98)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import featured, fit, fold, score_features

    rows = featured(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = fit(rows, _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score_features(rows, model).select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


def op9_bounded_load_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES, spark.createDataFrame([(d,) for d in LISTED], "key string"))


def op11_upper_triangle_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 8)


def op12_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op13_wavelet_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import group_variants

    return group_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sparse_suffix_array,
        op2_hilbert_search,
        op3_line_dedup,
        op4_nn_descent_dedup,
        embedding_links_planted,
        op5_byte_bpe,
        op6_weighted_minhash,
        op7_best_fit_packing,
        op8_pu_quality,
        op9_bounded_load_sharding,
        op10_url_filter,
        op11_upper_triangle_whitening,
        op12_whole_token_counts,
        op13_wavelet_variants,
    )
}

_OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
rep AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.doc_id, k.k, k.line, (r.first IS NOT NULL AND r.first < k.doc_id) AS gone FROM keyed k LEFT JOIN rep r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP10 = (
    r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
f AS (SELECT *, '.' || host AS h FROM p),
r AS (SELECT *, CASE WHEN ends_with(h, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
 WHEN ends_with(h, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN ends_with(h, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
 WHEN ends_with(h, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
 WHEN EXISTS (SELECT 1 FROM listed WHERE ends_with(h, '.' || d)) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
)
_OP10 = _OP10.replace("WITH p AS", "WITH listed(d) AS (VALUES " + ", ".join(f"('{d}')" for d in LISTED) + "), p AS")

_OP4 = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS other FROM e UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(low.component_id, m.vec_id) AS component_id, coalesce(m.vec_id = coalesce(low.component_id, m.vec_id), true) AS kept
FROM embeddings m LEFT JOIN n ON n.a = m.vec_id LEFT JOIN low ON low.id = m.vec_id
"""

_BENT = "list_transform(embedding, lambda x, i: (x::DOUBLE * (1::DOUBLE + {}::DOUBLE * ((i - 1) % 2)))::FLOAT)"
_PLANTED = _OP4.replace("FROM embeddings", "FROM planted").replace(
    "WITH RECURSIVE e AS",
    f"""WITH RECURSIVE planted AS (SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 10000000, label, {_BENT.format(0.05)} FROM embeddings WHERE vec_id % 5 < 2
 UNION ALL SELECT vec_id + 20000000, label, {_BENT.format(0.3)} FROM embeddings WHERE vec_id % 5 = 0), e AS""",
)

#: Words after the deletions, links by what is left when a code point is taken out, roots by recursion.
_OP13 = r"""
WITH RECURSIVE t8(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM t8 WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM t8 WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
pairs AS (SELECT doc_id, r, count(*) AS n, hex(encode(doc_id || ':' || r)) AS x FROM runs WHERE length(r) >= 5 GROUP BY doc_id, r),
hashed AS (SELECT doc_id, r, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM pairs, tab),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
masked AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM holes),
links AS (SELECT a.word, b.word AS other, b.n AS m FROM masked a JOIN masked b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM masked a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM masked a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM links GROUP BY word),
told AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk(word, place, step) AS (SELECT word, word, 0 FROM told UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN told f ON f.word = w.place WHERE f.form IS NOT NULL),
ends AS (SELECT word, first(place ORDER BY step DESC) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)
"""

ORACLE_SQL = {"op13_wavelet_variants": _OP13, "embedding_links_planted": _PLANTED, "op4_nn_descent_dedup": _OP4, "op3_line_dedup": _OP3, "op10_url_filter": _OP10}
