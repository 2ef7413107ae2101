"""The queries of the operators over their tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    blockmax_search,
    chat_format,
    cost_packing,
    covering_simhash,
    dac_tokens,
    entropy_mix,
    kd_shard,
    language_backoff,
    ngram_quality,
    topk_search,
    toxicity_ftrl,
    url_lists,
    vector_codes,
)
from .shared import cut, ensure_checkpoint_dir, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Fixed value: the conversation that the contract of op2 adds.
CONTROL_TURNS = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4()}"


def id_crc(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary"))


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shard.shards(table(spark, sf_dir, "documents"), 40)


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_windows(turns.unionByName(added), TOKENIZER))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors.where("vec_id % 100 = 0"), vectors, 10)


#: The list of op4 is made from the pages' hosts: each host whose checksum leaves 0 to 3 on division by 5 has dated events
#: (listed, freed or blocked again, taken off), hosts that leave 2 also have their /en/ pages listed, and example.org is
#: listed as a suffix. Dates and fetch times follow from checksums and page ids.
START = "2023-01-01 00:00:00"
HOST_SQL = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1))"


def list_events(pages: DataFrame) -> DataFrame:
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    c = F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long")
    day = lambda n: (F.lit(START).cast("timestamp") + F.make_dt_interval(n.cast("int"))).alias("dated")
    one = lambda pattern, verdict, n, when: hosts.where(when).select(pattern.alias("pattern"), F.lit(verdict).alias("verdict"), day(n))
    h = F.col("host")
    suffix = hosts.where("host like '%.example.org'").select(F.lit("example.org").alias("pattern"), F.lit("block").alias("verdict"), day(F.lit(300))).distinct()
    return (
        one(h, "block", c % 200, c % 5 < 4).unionByName(one(h, "allow", 200 + c % 100, c % 5 == 1)).unionByName(one(h, "drop", 200 + c % 300, c % 5 == 3))
        .unionByName(one(h, "block", 400 + c % 100, c % 5 == 1)).unionByName(one(F.concat(h, F.lit("/en/")), "allow", 100 + c % 400, c % 5 == 2)).unionByName(suffix)
    )


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    at = F.lit(START).cast("timestamp") + F.make_dt_interval(F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int"), F.pmod("page_id", F.lit(24)).cast("int"))
    captures = pages.select("page_id", "url", at.alias("fetched_at"))
    out = url_lists.judge(captures, list_events(pages))
    return out.select("page_id", "url", "fetched_at", "host", "pattern", "listed_on", "verdict", "blocked")


OP4_SQL = f"""
WITH caps AS (
  SELECT page_id, url, TIMESTAMP '{START}' + to_days(CAST((page_id * 37) % 730 AS INTEGER)) + to_hours(CAST(page_id % 24 AS BIGINT)) AS fetched_at,
         {HOST_SQL} AS host FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS c FROM caps WHERE host <> ''),
ev AS (
  SELECT host AS pattern, 'block' AS verdict, c % 200 AS d FROM h WHERE c % 5 < 4
  UNION ALL SELECT host, 'allow', 200 + c % 100 FROM h WHERE c % 5 = 1
  UNION ALL SELECT host, 'drop', 200 + c % 300 FROM h WHERE c % 5 = 3
  UNION ALL SELECT host, 'block', 400 + c % 100 FROM h WHERE c % 5 = 1
  UNION ALL SELECT host || '/en/', 'allow', 100 + c % 400 FROM h WHERE c % 5 = 2
  UNION ALL SELECT DISTINCT 'example.org', 'block', 300 FROM h WHERE host LIKE '%.example.org'),
one AS (SELECT pattern, d, max(verdict) AS verdict FROM ev GROUP BY pattern, d),
iv AS (
  SELECT pattern, verdict, TIMESTAMP '{START}' + to_days(CAST(d AS INTEGER)) AS valid_from,
         lead(TIMESTAMP '{START}' + to_days(CAST(d AS INTEGER))) OVER (PARTITION BY pattern ORDER BY d) AS valid_to FROM one),
hit AS (
  SELECT c.page_id, c.url, c.fetched_at, iv.pattern, iv.valid_from AS listed_on, iv.verdict,
         row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched_at ORDER BY length(iv.pattern) DESC) AS n
  FROM caps c JOIN iv ON iv.valid_from <= c.fetched_at AND (iv.valid_to IS NULL OR c.fetched_at < iv.valid_to) AND iv.verdict <> 'drop'
   AND (c.host = iv.pattern OR c.host LIKE '%.' || iv.pattern OR
        (iv.pattern LIKE '%/' AND substr(regexp_extract(c.url, '^[a-zA-Z]+://(.*)$', 1), 1, length(iv.pattern)) = iv.pattern)))
SELECT c.page_id, c.url, c.fetched_at, c.host, hit.pattern, hit.listed_on, coalesce(hit.verdict, 'none') AS verdict,
       coalesce(hit.verdict = 'block', false) AS blocked
FROM caps c LEFT JOIN hit ON hit.page_id = c.page_id AND hit.url = c.url AND hit.fetched_at = c.fetched_at AND hit.n = 1
"""


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(table(spark, sf_dir, "documents"))


def op6_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = cut(ngram_quality.features(docs, ngram_quality.fit(docs)))
    found = ngram_quality.judge(found, ngram_quality.bands(found))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity"]
    return found.select(*cols)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_ftrl.fit(docs, table(spark, sf_dir, "labels"), id_crc() % 5 != 0)
    out = toxicity_ftrl.score(docs, model)
    held = F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, 1024)


def op9_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_backoff.fit(docs, id_crc() % 3 != 1)
    out = language_backoff.predict(docs.select("doc_id", "text"), model)
    held = F.coalesce(id_crc() % 3 == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "lang_pred", "score")


def op11_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.compress(table(spark, sf_dir, "embeddings"), new_folder(spark, "codes"), parts=4, entries=256, rounds=4)
    out = vector_codes.label_errors(made.rows)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(made.sha256()).alias("codebooks_sha256"))


def op12_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    dac_tokens.write_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER, folder, end_id=2)
    return dac_tokens.read_docs(spark, folder)


def op13_blockmax_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = blockmax_search.save(blockmax_search.build(table(spark, sf_dir, "documents")), new_folder(spark, "index"))
    return blockmax_search.search(index, table(spark, sf_dir, "benchmark"), k=50)


OP3_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def _op11_sql(rounds: int = 4) -> str:
    nearest = """
a{r} AS MATERIALIZED (
  SELECT rid, part, any_value(v) AS v, min({{'d': CAST(xx - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS HUGEINT), 'entry': entry}}) AS m
  FROM pieces JOIN c{r} USING (part) GROUP BY rid, part)"""
    means = """
m{r} AS (
  SELECT part, entry, pos, CAST(floor(sum(x) / count(*)) AS DOUBLE) AS x
  FROM (SELECT part, m.entry AS entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a{p}) GROUP BY part, entry, pos),
c{r} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(n.v, c.c) AS c FROM c{p} c
  LEFT JOIN (SELECT part, entry, list(x ORDER BY pos) AS v FROM m{r} GROUP BY part, entry) n ON n.part = c.part AND n.entry = c.entry)"""
    steps = [nearest.format(r=0)] + [x.format(r=r, p=r - 1) for r in range(1, rounds + 1) for x in (means, nearest)]
    return f"""
WITH good AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
pieces AS MATERIALIZED (
  SELECT rid, part, v, list_inner_product(v, v) AS xx
  FROM (SELECT rid, p.part, list_slice(v, len(v) * p.part // 4 + 1, len(v) * (p.part + 1) // 4) AS v FROM good, (SELECT unnest(range(4)) AS part) p)),
c0 AS MATERIALIZED (SELECT part, rid AS entry, v AS c FROM pieces WHERE rid < 256),{",".join(steps)},
codes AS (SELECT rid, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
book AS (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS pos FROM c{rounds})
SELECT g.vec_id, k.code, k.error, CAST(sum(k.error) OVER (PARTITION BY g.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book) AS codebooks_sha256
FROM good g JOIN codes k USING (rid)
"""


OP11_SQL = _op11_sql()

OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
docs AS MATERIALIZED (SELECT rid, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS l FROM docs),
items AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
post AS MATERIALIZED (
  SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(c.n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM post, c GROUP BY term),
part AS (
  SELECT post.rid, post.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * docs.n * c.n) // c.l)))) AS s
  FROM post JOIN docs ON docs.rid = post.rid JOIN w ON w.term = post.term, c),
scored AS (SELECT i.item_id, p.rid, CAST(sum(p.s) AS BIGINT) AS score FROM items i JOIN part p ON p.term = i.term GROUP BY i.item_id, p.rid),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN docs USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def queries() -> dict:
    own = (
        op1_kd_shards, op2_chat_windows, op3_exact_topk, op4_url_lists, op5_entropy_mix, op6_perplexity_rules,
        op7_toxicity, op8_cost_packing, op9_covering_simhash, op10_language, op11_exponion_codes, op12_dac_tokens,
        op13_blockmax_search,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": OP3_SQL, "op4_url_lists": OP4_SQL, "op11_exponion_codes": OP11_SQL, "op13_blockmax_search": OP13_SQL}
