"""The operators bound to the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import decontaminate, fixity, htmltext, langid, linechunks, mixing, phrases, pii, prefixtrie, quality, sharding, simhash, tokencount
from lodeseek.llm.shared import shared_folder
from lodeseek.sources.scan import spread

SHARDS = 24
TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: A folder that lasts, for counts of earlier runs to be found again.
TOKEN_CACHE = "spark.lodeseek.token.cache"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table in fewer splits than there are cores is dealt out before Python works on it."""
    return spread(table(spark, sf_dir, "documents"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as drawn, with whole text; sources weigh as the square root of their bytes."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", "text"), mixing.source_rates(docs))
    return mixed.select("doc_id", "source", "text", F.col("_copy").cast("long").alias("copy"))


OP1_SQL = """
WITH RECURSIVE sized AS (
  SELECT source, sum(coalesce(octet_length(encode(text)), 0) + 8)::DOUBLE AS bytes FROM documents GROUP BY source
), rated AS (
  SELECT source, sqrt(bytes) / (SELECT sum(sqrt(bytes)) FROM sized) * (SELECT sum(bytes) FROM sized) / bytes AS rate FROM sized
), terms AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS total FROM rated
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln(k + 1), total + exp(log_p + ln(rate) - ln(k + 1)) FROM terms WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), drawn AS (
  SELECT doc_id, source, text, ('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.total <= d.u) AS n FROM drawn d
)
SELECT doc_id, source, text, unnest(range(n)) AS copy FROM counted
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the cache that the setting ``TOKEN_CACHE`` names, or where it is unset one of its own, which starts empty."""
    import public_tokenizers

    cache = spark.conf.get(TOKEN_CACHE, None) or f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    found = tokencount.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), cache, ["doc_id"])
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_benchmark(docs, benchmark, ["doc_id"])
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, pos, pos + 9), ' ') AS pattern, least(len(w), 10) AS length
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), places AS (
  SELECT doc_id, length, pos, array_to_string(list_slice(w, pos, pos + length - 1), ' ') AS pattern
  FROM (SELECT d.doc_id, d.w, l.length, unnest(range(1, len(d.w) - l.length + 2)) AS pos FROM doc_words d, (SELECT DISTINCT length FROM windows) l)
), hits AS (
  SELECT p.doc_id, p.pos, p.length, x.item_id FROM places p JOIN windows x USING (pattern, length)
), covered AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + length)) AS word FROM hits) GROUP BY doc_id
), met AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir), ["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")  # noqa: E731
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    n_spans, n_base = (F.size(c).cast("long") for c in ("spans", "base"))
    return found.select(
        "doc_id",
        *(count(k) for k in pii.KINDS),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        n_spans.alias("n_spans"),
        (n_spans - n_base).alias("n_added"),
    )


def op6_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document: counts, and the digest of its text."""
    cleaned = linechunks.remove_repeated_passages(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    return cleaned.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_chunks").alias("n_chunks"), F.col("_gone").alias("n_removed_chunks"), F.col("_gone_lines").alias("n_removed_lines"), digest)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against a replica with bit rot: in one of 64 pages, by the hash of its id, each e of the
    payload has become an f."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rotten = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2).isin("00", "40", "80", "c0")
    replica = pages.withColumn("html", F.when(rotten, F.translate("html", "e", "f")).otherwise(F.col("html")))
    found = fixity.audit(pages, replica)
    return found.select("page_id", "archive", "place", F.col("start").alias("start_byte"), F.col("stop").alias("stop_byte"), "digest", "status", "intact")


OP10_SQL = r"""
WITH layout AS (
  SELECT page_id,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    substr(md5(page_id::VARCHAR), 1, 2) IN ('00', '40', '80', 'c0') AND contains(coalesce(html, ''), 'e') AS rotten,
    (('0x' || substr(md5(concat_ws('|', coalesce(page_id::VARCHAR, ''), coalesce(url, ''))), 1, 8))::BIGINT
      % (SELECT greatest(1, ceil(coalesce(sum(octet_length(encode(html))), 0) / 8000000.0), ceil(count(*) / 500.0))::BIGINT FROM pages))::INTEGER AS archive
  FROM pages
), placed AS (
  SELECT page_id, archive, sha256(record) AS digest, octet_length(encode(record)) AS length, rotten FROM layout
)
SELECT page_id, archive, row_number() OVER w - 1 AS place,
  (sum(length) OVER w - length)::BIGINT AS start_byte, (sum(length) OVER w)::BIGINT AS stop_byte, digest,
  CASE WHEN coalesce(rotten, false) THEN 'damaged' ELSE 'intact' END AS status, NOT coalesce(rotten, false) AS intact
FROM placed WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING)
"""


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    return htmltext.extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(documents(spark, sf_dir))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k
), counts AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang
), cuts AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM counts WHERE k > 1
), rated AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, c.cut), ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, c.cut + 1, c.k), ' ')
), least_cut AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), parts AS (
  SELECT lang, f, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
  FROM (SELECT lang, f, w, size, unnest(range(1, k - size + 2)) AS i FROM (SELECT lang, k, f, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS size FROM counts WHERE k > 2))
), longer AS (
  SELECT lang, phrase, max(f) AS most FROM parts GROUP BY lang, phrase
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM least_cut LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR most < a
QUALIFY rank <= 2000
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(0, 256)) AS i)
), placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place FROM conversations WHERE conv_id IS NOT NULL
), taken AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM placed), crc_table
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, role, text FROM (
    SELECT t.conv_id, 0 AS own, p.place, p.role, p.text FROM taken t JOIN placed p ON p.conv_id = t.base AND p.place <= t.h
    UNION ALL
    SELECT p.conv_id, 1, p.place, p.role, p.text FROM placed p JOIN taken t USING (conv_id) WHERE p.place > t.h)
), paths AS (
  SELECT conv_id, depth, string_agg(key, '') OVER w AS path, coalesce(string_agg(key, '') OVER before, '') AS parent, words, depth = count(*) OVER (PARTITION BY conv_id) AS is_last
  FROM (SELECT *, md5(length(role) || ':' || role || text) AS key, len(regexp_extract_all(text, '[^ 	-]+')) AS words FROM turns)
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING), before AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), members AS (
  SELECT conv_id, depth, path, parent, words, is_last FROM paths
  UNION ALL
  SELECT conv_id, 0, '', NULL, 0, conv_id NOT IN (SELECT conv_id FROM turns) FROM taken
), nodes AS (
  SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_last), '')) AS ends_sha256
  FROM members GROUP BY path
), children AS (
  SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
  SELECT m.path, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n LEFT JOIN children c USING (path) JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.parent LEFT JOIN children c ON c.path = n.path JOIN subtrees s ON s.path = n.path
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_mix_sources,
        op2_token_counts,
        op3_benchmark_decontamination,
        op4_language_id,
        op5_personal_data,
        op6_kd_tree_sharding,
        op7_quality_rules,
        op8_line_chunk_dedup,
        op9_simhash_near_dedup,
        op10_warc_fixity_audit,
        op11_main_text,
        op12_phrase_mining,
        op13_conversation_trie,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op3_benchmark_decontamination": OP3_SQL, "op10_warc_fixity_audit": OP10_SQL, "op12_phrase_mining": OP12_SQL, "op13_conversation_trie": OP13_SQL}
