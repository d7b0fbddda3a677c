"""The registered queries of this subpackage: one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.chat import conversation_digests, format_conversations
from weft.llm.common import crc_of_id, table
from weft.llm.decontaminate import decontaminate
from weft.llm.embedding_dedup import embedding_near_duplicates
from weft.llm.media_query import media_digests
from weft.llm.mixing import mix_sources
from weft.llm.ngram_join import ngram_jaccard_join
from weft.llm.quality import fit_quality
from weft.llm.resample import importance_resample
from weft.llm.sentencepiece import decode_ids, encode_texts
from weft.llm.sharding import shard_by_bytes
from weft.llm.toxicity import fit_toxicity, score_texts
from weft.llm.url_filters import URL, filter_urls, host_of
from weft.llm.vector_codes import code_errors, compress_vectors


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as rows of 192 grey samples in a TIFF file, read back page by page."""
    return media_digests(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, linked where 100 * intersection >= 90 * union."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


#: A score from here on predicts label 1.
THRESHOLD = 0.3


def _scores(docs: DataFrame, model, folds: int, fold: int) -> DataFrame:
    scored = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (crc_of_id() % folds == fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; learned from labels outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_of_id() % 4 != 2)
    return _scores(docs, model, 4, 2)


#: The vocabulary of the encoding query, a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the text read back from them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    back = decode_ids(encode_texts(docs, PIECES), PIECES)
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    ids = F.array_join("token_ids", " ")
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("restored"))


#: A conversation that every run adds: texts made of control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return conversation_digests(format_conversations(turns.unionByName(added)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; learned from labels outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    return _scores(docs, model, 5, 0)


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of near equal bytes; equal texts stay together."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def dated_entries(pages: DataFrame) -> DataFrame:
    """A history of list entries for the hosts of the pages, made from a hash of each host.

    A third of the hosts are blocked, cleared after 60 days and blocked again
    after 60 more; for a fifth, pages below one part of the path are allowed from
    some day on; the domain above all is blocked for 30 days.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct().selectExpr("host", "cast(conv(substr(md5(host), 1, 4), 16, 10) AS int) n")
    day = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, {})"
    block = hosts.filter("n % 3 = 0").selectExpr("'block' list", "host key", f"inline(array(struct('add' action, {day.format('n % 180')} at), struct('remove' action, {day.format('n % 180 + 60')} at), struct('add' action, {day.format('n % 180 + 120')} at)))")
    allow = hosts.filter("n % 5 = 0").selectExpr("'allow' list", "concat(host, '/fr') key", "'add' action", f"{day.format('n % 100')} at")
    domain = pages.sparkSession.range(2).selectExpr("'block' list", "'example.com' key", "if(id = 0, 'add', 'remove') action", f"{day.format('cast(200 + id * 30 AS int)')} at")
    return block.unionAll(allow).unionAll(domain)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture at a time of 2024, against the entries active then."""
    pages = table(spark, sf_dir, "pages")
    fetched = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id * 37 % 366 AS int), 0, 0, cast(page_id * 101 % 86400 AS int))"
    captures = pages.selectExpr("page_id", "url", f"{fetched} fetched_at")
    return filter_urls(captures, dated_entries(pages)).select("page_id", "url", "fetched_at", "verdict", "matched_list", "matched_key", "listed_since")


def op9_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn and share the sum of all words."""
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.98 or more."""
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of all documents of 20 words or more, drawn towards the benchmark's distribution of runs of words."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=(5, 100), least_words=20, buckets=10_000, run=3, seed=42)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside ten consecutive words of a benchmark item, and the items these are of."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10, slack=5)
    return out.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256)).drop("item_ids")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as sixteen indexes into codebooks of 64 entries, after two rounds."""
    codes = compress_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return code_errors(codes).drop("label").withColumn("codebooks_sha256", F.lit(codes.digest()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tiff_pages": op1_tiff_pages,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_minimax_shards": op7_minimax_shards,
    "op8_url_filters": op8_url_filters,
    "op9_budget_mix": op9_budget_mix,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_decontamination": op12_decontamination,
    "op13_vector_codes": op13_vector_codes,
}

_URL_PATTERN = URL.replace("'", "''")



def _assigned(k: int) -> str:
    """SQL of the nearest entry of each part in codebook ``k``."""
    return f"""a{k} AS (
  SELECT rid, part, any_value(q) q, arg_min(entry, (dist, entry)) entry, min(dist) dist
  FROM (SELECT p.rid, part, p.q, entry, list_sum(list_transform(range(1, len(p.q) + 1), lambda i: (p.q[i] - c.q[i]) * (p.q[i] - c.q[i])))::bigint dist FROM p JOIN c{k} c USING (part)) GROUP BY rid, part
)"""


def _moved(k: int) -> str:
    """SQL of codebook ``k + 1``: floors of means, unused entries as they were."""
    return f"""c{k + 1} AS (
  SELECT part, entry, coalesce(m.q, c.q) q FROM c{k} c LEFT JOIN (
    SELECT part, entry, list(floor(s / n)::bigint ORDER BY i) q FROM (SELECT part, entry, i, sum(q[i])::double s, count(*)::double n FROM a{k}, LATERAL (SELECT unnest(range(1, len(q) + 1)) i) GROUP BY part, entry, i) GROUP BY part, entry
  ) m USING (part, entry)
)"""


ORACLE: dict[str, str] = {
    "op8_url_filters": rf"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(cast(page_id * 37 % 366 AS int)) + to_seconds(page_id * 101 % 86400) fetched_at,
         rtrim(lower(regexp_extract(url, '{_URL_PATTERN}', 1)), '.') host, regexp_extract(url, '{_URL_PATTERN}', 2) path
  FROM pages
), h AS (
  SELECT host, ('0x' || substr(md5(host), 1, 4))::int n FROM p WHERE host <> '' GROUP BY host
), e AS (
  SELECT 'block' list, host AS key, a.action, TIMESTAMP '2024-01-01' + to_days(cast(n % 180 + a.d AS int)) AS dt
  FROM h, (VALUES ('add', 0), ('remove', 60), ('add', 120)) a(action, d) WHERE n % 3 = 0
  UNION ALL SELECT 'allow', host || '/fr', 'add', TIMESTAMP '2024-01-01' + to_days(cast(n % 100 AS int)) FROM h WHERE n % 5 = 0
  UNION ALL SELECT 'block', 'example.com', 'add', TIMESTAMP '2024-01-01' + to_days(200)
  UNION ALL SELECT 'block', 'example.com', 'remove', TIMESTAMP '2024-01-01' + to_days(230)
), v AS (
  SELECT * FROM (SELECT *, lead(dt) OVER (PARTITION BY list, key ORDER BY dt, CASE action WHEN 'add' THEN 0 ELSE 1 END) until FROM e)
  WHERE action = 'add' AND (until IS NULL OR until > dt)
), m AS (
  SELECT p.page_id, v.list, v.key, v.dt,
         row_number() OVER (PARTITION BY p.page_id ORDER BY len(string_split(v.key, '/')) DESC, len(string_split(string_split(v.key, '/')[1], '.')) DESC, (v.list = 'allow')::int DESC, v.list DESC, v.key DESC, v.dt DESC) k
  FROM p JOIN v ON (p.host = v.key OR ends_with(p.host, '.' || v.key)
       OR starts_with(p.host || '/' || array_to_string(list_filter(string_split(p.path, '/'), lambda x: x <> ''), '/') || '/', v.key || '/') AND contains(v.key, '/'))
     AND v.dt <= p.fetched_at AND (v.until IS NULL OR p.fetched_at < v.until)
)
SELECT p.page_id, p.url, p.fetched_at, CASE WHEN m.list = 'allow' THEN 'allow' WHEN m.list IS NOT NULL THEN 'block' ELSE 'none' END verdict,
       m.list matched_list, m.key matched_key, m.dt listed_since
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
""",
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) s FROM w
), n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT r.a doc_id, coalesce(any_value(n.n), 0) n_shingles, min(r.b) component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
""",
    "op5_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS safe FROM c)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(safe) + length('<|im_end|>') + 1)::bigint formatted_chars
FROM e GROUP BY 1
""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, cast(embedding AS double[]) e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), l AS (
  SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) n FROM l GROUP BY 1)
SELECT r.a vec_id, coalesce(any_value(n.n), 0) n_links, min(r.b) component_id, r.a = min(r.b) kept FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a
""",
    "op11_importance_resampling": r"""
WITH tab AS (
  SELECT list(v ORDER BY i) t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) v FROM range(256) r(i))
), w AS (
  SELECT rid, doc_id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  FROM (SELECT row_number() OVER () rid, doc_id, 0 kind, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, 1, text FROM benchmark)
), u AS (
  SELECT rid, kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) f FROM w
), f AS (SELECT rid, kind, f, count(*) n FROM u GROUP BY ALL
), h AS (SELECT f, hex(encode(f)) h FROM (SELECT DISTINCT f FROM f)
), b AS (
  SELECT f, xor(list_reduce(list_transform(range(0, length(h), 2), lambda i: (strpos('0123456789ABCDEF', h[i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 2]) - 1),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 b FROM h, tab
), c AS (SELECT b, coalesce(sum(n) FILTER (kind = 0), 0)::double s, coalesce(sum(n) FILTER (kind = 1), 0)::double t FROM f JOIN b USING (f) GROUP BY b
), g AS (SELECT b, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::bigint gain FROM c
), d AS (SELECT rid, sum(n)::bigint n, sum(n * gain)::bigint weight FROM f JOIN b USING (f) JOIN g USING (b) WHERE kind = 0 GROUP BY rid
), s AS (
  SELECT w.doc_id, len(w.w) words, coalesce(d.n, 0) n_features, coalesce(d.weight, 0) weight,
         coalesce(d.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score
  FROM w LEFT JOIN d USING (rid) WHERE w.kind = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) k, count(*) FILTER (words >= 20) OVER () n FROM s)
SELECT doc_id, words::bigint n_words, n_features, weight, score, CASE WHEN words >= 20 AND k <= 5 * n // 100 THEN k END "rank" FROM r
""",
    "op12_decontamination": r"""
WITH t AS (
  SELECT row_number() OVER () rid, doc_id, NULL item_id, text, true of_docs FROM documents UNION ALL SELECT 0, NULL, coalesce(item_id::varchar, ''), text, false FROM benchmark
), w AS (
  SELECT * EXCLUDE text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM t
), own AS (
  SELECT DISTINCT item_id, x FROM (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w] ELSE list_transform(range(len(w) - 9), lambda k: w[k + 1:k + 10]) END) x FROM w WHERE NOT of_docs)
), x AS (SELECT DISTINCT x FROM own
), occ AS (
  SELECT rid, pos, len(g.x) n, x FROM (SELECT rid, pos, w[pos + 1:pos + n] x FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) pos FROM w, (SELECT DISTINCT len(x) n FROM x) WHERE of_docs AND len(w) >= n)) g SEMI JOIN x USING (x)
), hit AS (SELECT rid, count(DISTINCT p) n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) p FROM occ) GROUP BY rid
), items AS (SELECT rid, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT rid, item_id FROM occ JOIN own USING (x)) GROUP BY rid
), post AS (SELECT rid, unnest(w) t, unnest(range(len(w))) pos FROM w WHERE of_docs
), a AS (
  SELECT x, t, off, row_number() OVER (PARTITION BY x ORDER BY n, off) k
  FROM (SELECT x, unnest(x) t, unnest(range(len(x))) off FROM x) LEFT JOIN (SELECT t, count(*) n FROM post GROUP BY t) USING (t) QUALIFY count(n) OVER (PARTITION BY x) = len(x)
), first AS (SELECT DISTINCT rid, pos - off s, x FROM a JOIN post USING (t) WHERE k = 1
), more AS (
  SELECT rid, s, x, count(DISTINCT k) c FROM first JOIN (SELECT * FROM a WHERE k IN (2, 3)) USING (x) JOIN post USING (rid, t) WHERE abs(pos - s - off) <= 5 GROUP BY ALL
), near AS (
  SELECT rid, count(DISTINCT item_id) n_near FROM first LEFT JOIN more USING (rid, s, x) JOIN own USING (x) WHERE coalesce(c, 0) = least(len(x), 3) - 1 GROUP BY rid
)
SELECT w.doc_id, len(w.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_near, 0)::bigint n_near, coalesce(n_hit, 0) > 0 contaminated
FROM w LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near USING (rid) WHERE w.of_docs
""",
    "op13_vector_codes": f"""
WITH v AS (
  SELECT row_number() OVER () rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e, len(embedding) // 16 w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (SELECT rid, part, e[part * w + 1:part * w + w] q FROM v, range(16) r(part)
), c0 AS (SELECT part, entry, q FROM (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 entry FROM v) JOIN p USING (rid) WHERE entry < 64
), {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
books AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) codebooks_sha256 FROM c2),
told AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) code, sum(dist)::bigint error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint label_error, codebooks_sha256 FROM told JOIN v USING (rid), books
""",
}
