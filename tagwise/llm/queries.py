"""Queries of this subpackage over the tables in ``sf_dir``: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, langid, neardup, pseudo_likelihood, quality, substring, token_counts, warc

#: Where the vocabulary comes from; a parameter of the operators.
VOCABULARY, PATTERN = "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), PATTERN, keep=["doc_id"])
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path(VOCABULARY), PATTERN, keep=["doc_id"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.classes(docs).select("doc_id", "class_id", (F.col("key") == F.col("representative")).alias("kept"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudo_likelihood.score_corpus(docs)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "distance")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, normal=True).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], given.schema)
    return chat.read_back(chat.format_chats(given.unionByName(extra)), in_order=True)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs, where=~langid.held_out())
    return langid.identify(docs, model, keep=["doc_id"]).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return warc.round_trip(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_RULES = len(quality.RULES)
_NAMES = ", ".join(f"v{i}" for i in range(_RULES))
_VOTES = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{i}" for i, (_, bad, good) in enumerate(quality.RULES))

#: The vocabulary's tokens in hex; the matches of the pattern in each text, in order; the distinct ones.  RE2 has no look-ahead:
#: a private character is put before the last blank of each run, where the pattern would stop, and the pattern without it.
_MATCHES = r"""
vocab AS MATERIALIZED (
  SELECT hex(from_base64(a)) AS h, b AS id FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'a': 'VARCHAR', 'b': 'BIGINT'}})
), piece AS (
  SELECT doc_id, i, m[i] AS x FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(regexp_replace(text, '([\s\x0B\x{{85}}\p{{Z}}][^\s\x0B\x{{85}}\p{{Z}}])', chr(57344) || '\1', 'g'),
      '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\x0B\x{{85}}\p{{Z}}\p{{L}}\p{{N}}\x{{E000}}]+|[\s\x0B\x{{85}}\p{{Z}}]+') AS m FROM documents WHERE text IS NOT NULL))
), word AS MATERIALIZED (
  SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM piece)
)""".format(path=public_tokenizers.path(VOCABULARY))

#: DuckDB SQL where it can express a query: merges pair by pair, best ways through words, figures and EM over vote patterns,
#: all pairs of texts that share a shingle, edit distance row by row to texts that hold a piece of an item, 35-word windows,
#: chat segments, archive records.
ORACLES = {
    "op1_bpe": f"WITH RECURSIVE {_MATCHES}"
    r""", bpe(step, x, l) AS (
  SELECT 0, x, list_transform(range(0, length(h) // 2), lambda i: h[2 * i + 1 : 2 * i + 2]) FROM word ANTI JOIN vocab USING (h)
  UNION ALL
  SELECT step + 1, x, l[: best % 65536 - 1] || [l[best % 65536] || l[best % 65536 + 1]] || l[best % 65536 + 2 :] FROM (
    SELECT step, x, l, min(v.id * 65536 + i) AS best FROM (SELECT step, x, l, unnest(range(1, len(l))) AS i FROM bpe) b JOIN vocab v ON v.h = l[i] || l[i + 1] GROUP BY ALL)
), done AS (
  SELECT x, unnest(range(1, len(l) + 1)) AS j, l FROM (SELECT x, arg_max(l, step) AS l FROM bpe GROUP BY x) UNION ALL SELECT x, 1, [h] FROM word SEMI JOIN vocab USING (h)
), ids AS (
  SELECT x, count(*) AS n, string_agg(v.id::VARCHAR, ',' ORDER BY j) AS s FROM done JOIN vocab v ON v.h = l[j] GROUP BY x
), line AS (
  SELECT doc_id, sum(n)::BIGINT AS n, string_agg(s, ',' ORDER BY i) AS s FROM piece JOIN ids USING (x) GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_tokens, sha256(coalesce(s, '')) AS ids_sha256, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents LEFT JOIN line USING (doc_id)
""",
    "op2_token_counts": f"WITH RECURSIVE {_MATCHES}"
    r""", edge AS MATERIALIZED (
  SELECT x, s, e, -ln(id + 2) AS p FROM (SELECT x, h, s, unnest(range(s + 1, least(length(h) // 2, s + (SELECT max(length(h)) // 2 FROM vocab)) + 1)) AS e FROM (SELECT *, unnest(range(0, length(h) // 2)) AS s FROM word)) c
  JOIN vocab v ON v.h = c.h[2 * s + 1 : 2 * e]
), dp(x, e, best, n) AS (
  SELECT x, 0::BIGINT, [0.0::DOUBLE], [0::BIGINT] FROM word
  UNION ALL
  SELECT * FROM (
    WITH way AS (
      SELECT d.x, d.e + 1 AS e, any_value(d.best) AS best, any_value(d.n) AS n, max(d.best[g.s + 1] + g.p) AS top, list((d.best[g.s + 1] + g.p, d.n[g.s + 1] + 1)) AS ways
      FROM dp d JOIN edge g ON g.x = d.x AND g.e = d.e + 1 GROUP BY d.x, d.e
    )
    SELECT x, e, list_append(best, top), list_append(n, list_min(list_transform(list_filter(ways, lambda y: y[1] > top - 1e-9), lambda y: y[2]))) FROM way
  )
), cost AS (
  SELECT x, arg_max(n, e)[-1] AS n FROM dp GROUP BY x
)
SELECT doc_id, coalesce(sum(n), 0)::BIGINT AS n_tokens FROM documents LEFT JOIN (SELECT doc_id, n FROM piece JOIN cost USING (x)) USING (doc_id) GROUP BY doc_id
""",
    "op3_quality": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), win AS (
  SELECT doc_id, i, concat_ws(chr(10), w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT * FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1)) GROUP BY doc_id
), f AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)
), v AS MATERIALIZED (
  SELECT *, {_VOTES} FROM f
), pat AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY {_NAMES}) AS id, *, [{_NAMES}] AS votes FROM (SELECT {_NAMES}, count(*) AS n FROM v GROUP BY ALL)
), vote AS MATERIALIZED (
  SELECT id, n, r, votes[r + 1] AS x FROM (SELECT *, unnest(range(0, {_RULES})) AS r FROM pat)
), em(it, k, r, x, p) AS (
  SELECT 0, k, r, x, p FROM (
    SELECT k, -1 AS r, 0 AS x, CASE WHEN k = 0 THEN {quality.PRIOR_GOOD} ELSE {1 - quality.PRIOR_GOOD} / {_RULES} END::DOUBLE AS p FROM range(0, {_RULES + 1}) a(k)
    UNION ALL SELECT k, r, x, CASE WHEN k = r + 1 THEN own ELSE other END::DOUBLE FROM range(0, {_RULES + 1}) a(k), range(0, {_RULES}) b(r), (VALUES {", ".join(f"({v}, {o}, {t})" for v, o, t in zip(quality.VOTES, quality.OWN, quality.OTHER))}) c(x, own, other))
  UNION ALL
  SELECT * FROM (
    WITH cur AS (
      SELECT * FROM em WHERE it < {quality.ITERATIONS}
    ), fit AS (
      SELECT vote.id, vote.n, c.k, sum(ln(c.p)) AS s FROM vote JOIN cur c ON c.r = vote.r AND c.x = vote.x GROUP BY ALL
    ), post AS (
      SELECT id, n, k, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM (SELECT f.id, f.n, f.k, f.s + ln(c.p) AS s FROM fit f JOIN cur c ON c.r = -1 AND c.k = f.k)
    ), share AS (
      SELECT id, k, n * e / sum(e) OVER (PARTITION BY id) AS m FROM post
    ), total AS (
      SELECT k, -1 AS r, 0 AS x, {quality.SMOOTHING} + sum(m) AS m FROM share GROUP BY k
      UNION ALL SELECT s.k, vote.r, vote.x, sum(s.m) FROM share s JOIN vote ON vote.id = s.id GROUP BY ALL
    ), new AS (
      SELECT c.it + 1 AS it, c.k, c.r, c.x, coalesce(t.m, 0) + CASE WHEN c.r < 0 THEN 0 ELSE {quality.SMOOTHING / 10} END AS m FROM cur c LEFT JOIN total t ON t.k = c.k AND t.r = c.r AND t.x = c.x
    )
    SELECT it, k, r, x, m / sum(m) OVER (PARTITION BY r, CASE WHEN r < 0 THEN 0 ELSE k END) FROM new
  )
), last AS MATERIALIZED (
  SELECT k, r, x, p FROM em WHERE it = {quality.ITERATIONS}
), odds AS (
  SELECT id, k, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM (
    SELECT f.id, f.k, f.s + ln(c.p) AS s FROM (SELECT vote.id, c.k, sum(ln(c.p)) AS s FROM vote JOIN last c ON c.r = vote.r AND c.x = vote.x GROUP BY ALL) f JOIN last c ON c.r = -1 AND c.k = f.k)
), good AS (
  SELECT id, round(sum(e) FILTER (k = 0) / sum(e), 6) AS p_good FROM odds GROUP BY id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND p_good >= 0.5 AS kept, p_good
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed FROM v) JOIN pat USING ({_NAMES}) JOIN good USING (id)
""",
    "op4_neardup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0) GROUP BY ALL
), size AS (
  SELECT doc_id, sum(n) AS t FROM g GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE common >= 0.8 * (x.t + y.t - common) - 1e-9
), reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION SELECT r.doc_id, l.other FROM reach r JOIN (SELECT a, b AS other FROM link UNION ALL SELECT b, a FROM link) l ON l.a = r.other
)
SELECT doc_id, min(other) AS class_id, min(other) = doc_id AS kept FROM reach GROUP BY doc_id
""",
    "op6_decontaminate": r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, trim(regexp_replace(lower(text), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL
), item AS (
  SELECT *, length(p) // 14 AS k FROM (SELECT item_id, trim(regexp_replace(lower(text), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')) AS p FROM benchmark WHERE text IS NOT NULL) WHERE p <> ''
), piece AS (
  SELECT item_id, p, k, p[i * length(p) // (k + 1) + 1 : (i + 1) * length(p) // (k + 1)] AS x FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM item)
), pair AS (
  SELECT DISTINCT doc_id, item_id, p, k, t FROM piece JOIN doc ON contains(t, x)
), place AS (
  SELECT row_number() OVER (ORDER BY doc_id, item_id) AS id, * FROM pair
), spot AS (
  SELECT id, j, t[j] AS c FROM (SELECT id, t, unnest(range(0, length(t) + 1)) AS j FROM place)
), dp(i, id, j, v) AS (
  SELECT 0, id, j, 0::BIGINT FROM spot
  UNION ALL
  SELECT * FROM (
    WITH up AS (
      SELECT d.i, d.id, d.j, d.v, lag(d.v) OVER (PARTITION BY d.id ORDER BY d.j) AS diagonal FROM dp d
    ), step AS (
      SELECT u.i + 1 AS i, u.id, u.j, CASE WHEN u.j = 0 THEN u.i + 1 ELSE least(u.v + 1, u.diagonal + CASE WHEN s.c = x.p[u.i + 1] THEN 0 ELSE 1 END) END AS v
      FROM up u JOIN place x ON x.id = u.id JOIN spot s ON s.id = u.id AND s.j = u.j WHERE u.i < length(x.p)
    )
    SELECT i, id, j, min(v - j) OVER (PARTITION BY id ORDER BY j) + j FROM step
  )
)
SELECT doc_id, item_id, min(v)::INTEGER AS distance FROM dp JOIN place USING (id) WHERE i = length(p) GROUP BY doc_id, item_id, k HAVING min(v) <= k
""",
    "op7_substring": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), dup AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN dup USING (h))
), word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d
), kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op8_chat": r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
    length(role) + 4 + 2 + 9 + length(regexp_replace(text, '(\\|### |</turn>)', 'x\1', 'g')) AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(coalesce(before, 'start') || ' ' || role IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user')) AS valid
FROM s GROUP BY conv_id
""",
    "op10_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
""",
}
