"""The registered queries of this subpackage, with production parameters, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.llm import bpe, filter_audit, packing, sharding, token_files, toxicity, url_filters
from penumbra.llm.exact_dedup import exact_duplicates
from penumbra.llm.hard_negatives import hard_negatives
from penumbra.llm.language_model import score_documents
from penumbra.llm.near_dedup import near_duplicates
from penumbra.llm.personal_data import KINDS, find_personal_data, span_list
from penumbra.llm.topk import top_k


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth embedding with all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose counts differ by one at most."""
    return sharding.shard_documents(_documents(spark, sf_dir), shards=40, seed=2)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder, manifest = token_files.write_token_files(_documents(spark, sf_dir), path, end_id=2)
    read = token_files.read_token_files(folder, manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(_documents(spark, sf_dir), path, end_id=0, window=2048)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labelled rows that are not held out."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with a rank file."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode_documents(bpe.encode_documents(_documents(spark, sf_dir), path, pattern), path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return exact_duplicates(_documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; the counts are of base spans."""
    found = find_personal_data(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity 0.85."""
    return near_duplicates(_documents(spark, sf_dir), width=3, percent=85)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under the trigram automaton and under its root."""
    return score_documents(_documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, the labels of every seventh moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters remove from each source of all documents in every order."""
    return filter_audit.filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Rules of the registered query.
HOST_RULES = [
    url_filters.HostRule("block", "net", "/"),
    url_filters.HostRule("allow", "example.net", "/en/"),
    url_filters.HostRule("block", "example.com", "/de/"),
    url_filters.HostRule("allow", "org", "/fr/"),
]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return url_filters.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), HOST_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_sharding": op2_sharding,
    "op3_token_output": op3_token_output,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_filters": op13_url_filters,
}

WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"



def _feistel_sql(source: str, seed: int) -> str:
    """One pass of the permutation network over column p of ``source``, with sides a, b beside it."""
    sql = f"SELECT * EXCLUDE (p), p // b AS l, p % b AS r FROM ({source})"
    for i in range(sharding.ROUNDS):
        one, other, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        m, n = sharding.MULTIPLIERS[i], sharding.MULTIPLIERS[(i + 1) % sharding.ROUNDS]
        k = (seed * 7919 + i * 104729) % sharding.MODULUS
        x = f"(({other} % {sharding.MODULUS} + {k}) % {sharding.MODULUS} * {m} + 12345) % {sharding.MODULUS} * {n} % {sharding.SECOND_MODULUS} % {side}"
        sql = f"SELECT * REPLACE (({one} + {x}) % {side} AS {one}) FROM ({sql})"
    return f"SELECT * EXCLUDE (l, r), l * b + r AS p FROM ({sql})"


def _words_sql() -> str:
    """The smallest word rule that fits address ``a``, in SQL."""
    any_run = "[A-Za-z0-9]*"
    one = [f"CASE WHEN regexp_matches(a, '(?i)(?:^|[^A-Za-z0-9]){w.words.replace('*', any_run)}(?:$|[^A-Za-z0-9])') THEN '{w.words}' END" for w in url_filters.BLOCKED_WORDS]
    return f"list_min([{', '.join(one)}])"


ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
WITH ok AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
  FROM pairs WHERE same QUALIFY positive_rank <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score, positive_rank::INTEGER AS positive_rank
FROM positives JOIN (SELECT * FROM pairs WHERE NOT same) USING (anchor_id)
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
""",
    "op12_filter_audit": r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
fails AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f FROM words),
flagged AS (SELECT fails.*, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM fails LEFT JOIN labels USING (doc_id)),
cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS x FROM flagged GROUP BY 1, 2),
one AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (
  SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, s.i AS step, o[s.i] AS own, o[1:s.i - 1] AS before FROM orders, one s),
met AS (
  SELECT part, filter_order, step, own, n, g, x, f[own] AS hit, len(list_filter(before, lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda y: y)) = 1 AS lone
  FROM cells, steps),
told AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND lone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN x ELSE 0 END) AS toxic_lost
  FROM met GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, substr('ABCDE', own, 1) AS filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told
""",
    "op13_url_filters": rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM parts),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(v, h, p)),
judged AS (
  SELECT page_id, host, path, {_words_sql()} AS word,
    (SELECT arg_max(struct_pack(n := h || p, v := v), length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r
  FROM (SELECT *, host || path AS a FROM split))
SELECT page_id, host, path, r.n AS rule, coalesce(r.v, CASE WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, word FROM judged
""",
    "op7_minhash_near_dedup": f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (
  SELECT doc_id AS node, doc_id AS r FROM documents
  UNION
  SELECT reach.node, e.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = reach.r),
component AS (SELECT node AS doc_id, min(r) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM component LEFT JOIN sizes USING (doc_id)
""",
    "op1_topk_search": """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""",
    "op2_sharding": f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bs FROM documents),
slim AS (
  SELECT doc_id, len(bs) + 16 AS size,
    xor(list_reduce([4294967295::BIGINT] || bs, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc),
dims AS (
  SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a, ((count(*) + ceil(sqrt(count(*)))::BIGINT - 1) // ceil(sqrt(count(*)))::BIGINT) AS b FROM slim),
ranked AS (
  SELECT slim.*, n, a, b, row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1 AS row_number FROM slim, dims),
walk AS (
  {_feistel_sql("SELECT *, row_number AS p FROM ranked", 2)}
  UNION ALL
  {_feistel_sql("SELECT * FROM walk WHERE p >= n", 2)})
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (p % 40)::INTEGER AS shard, p // 40 AS slot, NULL::INTEGER AS grown_shard, row_number
FROM walk WHERE p < n
""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
}
