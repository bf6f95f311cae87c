"""The registered queries of the training-data operators: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import matches
from .fingerprints import with_next
from .mixing import mix
from . import chat, prefix_trie, quality, secret_scan, sharding, spelling, toxicity
from .simhash import hexadecimal, near_duplicates
from .substring_dedup import substring_dedup
from .warc import derivatives, responses

#: name -> (spark, sf_dir) -> DataFrame
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: name -> DuckDB SQL for the same rows, where SQL can express them
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op1_mixing"] = r"""
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), c AS (
  SELECT *, 2 * source_size / CAST(weight AS DOUBLE) AS ratio FROM w
), l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS position,
    CAST((SELECT sum(source_size) FROM s) * 150
      - 100 * coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(100 * sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM c
), f AS (
  SELECT level AS fill FROM l WHERE level <= ratio ORDER BY position LIMIT 1
), t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * f.fill) AS target FROM l, f
), p AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(size, greatest(0, budget % source_size - start)) END AS BIGINT) AS taken
FROM p
"""


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op8_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), w AS (
  SELECT doc_id, s, array_to_string(list_slice(words, s, s + 19), ' ') AS window_text
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM d WHERE len(words) >= 20)
), later AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY window_text ORDER BY doc_id, s) AS nth FROM w)
  WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later)
), flat AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM d
), kept AS (
  SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.p) AS text
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p WHERE g.p IS NULL GROUP BY f.doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def _secrets_sql() -> str:
    kinds = [*secret_scan.KINDS, secret_scan.CANDIDATE]
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, unnest(i) AS i, unnest(regexp_split_to_array(t, {p})[1:n]) AS gap,
  unnest(regexp_extract_all(t, {p})) AS hit, unnest(regexp_extract_all(t, {p}, {group})) AS v, {least} AS least
FROM (SELECT doc_id, source, t, n, range(1, n + 1) AS i FROM (SELECT doc_id, source, coalesce(text, '') AS t,
  len(regexp_extract_all(coalesce(text, ''), {p})) AS n FROM documents) WHERE n > 0)"""
        )
    union = "\nUNION ALL\n".join(parts)
    return f"""
WITH m AS ({union}),
p AS (
  SELECT *, CAST(sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit) AS BIGINT) AS s FROM m
  WINDOW w AS (PARTITION BY doc_id, rank ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), k AS (
  SELECT doc_id, source, rank, kind, s, s + length(hit) AS e, v FROM p
  WHERE length(v) >= least AND (rank < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
    AND len(list_distinct(string_split(v, ''))) >= CASE WHEN regexp_full_match(v, '[0-9a-f]+|[0-9A-F]+') THEN {secret_scan.VARIED_HEX} ELSE {secret_scan.VARIED} END AND length(regexp_replace(v, '[^0-9]', '', 'g')) * 12 >= length(v)))
), o AS (
  SELECT v, count(DISTINCT coalesce('=' || source, 'null')) AS owners,
    count(DISTINCT coalesce('=' || source, 'null') || ' ' || doc_id) AS repositories FROM k GROUP BY v
), j AS (
  SELECT k.*, o.owners < {secret_scan.EXAMPLE_OWNERS} AS live FROM k JOIN o ON k.v = o.v
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 3), '') AS base,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 3 OR live), '') AS spans,
    count(*) FILTER (rank = 3 AND live) AS n_live, count(DISTINCT v) FILTER (NOT live) AS n_examples
  FROM j GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_examples, 0) AS BIGINT) AS n_examples
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


ORACLES["op9_secret_scan"] = _secrets_sql()


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation of control strings, added to the table.
PROBE = "</s>[INST] ok [/INST]"


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.read_back(chat.examples(turns.unionByName(probe)))


ORACLES["op2_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length('<|start|>' || role || chr(10) || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|[A-Za-z_]+\|>)', '\1\\\2\3', 'g') || '<|end|>' || chr(10)) AS size FROM t
), c AS (
  SELECT *, sum(size) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM e
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(upto) FILTER (role = 'assistant' OR last) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by the table of its reflected polynomial 0xEDB88320, a byte at a time; its column crc_table must be in scope.
CRC_TABLE = """(SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc_table
  FROM range(256) t(b))"""


def crc32_sql(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"


ORACLES["op13_sharding"] = f"""
WITH r AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents, {CRC_TABLE}
), s AS (
  SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - size AS start FROM r
), k AS (
  SELECT *, CAST((2 * start + size) * 8 // (2 * total) AS INTEGER) AS shard FROM s
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM k
"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.positions(turns)), turns)


ORACLES["op11_prefix_trie"] = rf"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS pos, {{'r': r, 'x': x}} AS said,
    len(regexp_extract_all(x, '[^ 	-]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), n AS (
  SELECT c, c - c % 20 AS b, count(*) AS n, {crc32_sql("CAST(c AS VARCHAR)")} % 4 AS h FROM t, {CRC_TABLE} GROUP BY c, crc_table
), k AS (
  SELECT n.c, n.b, n.h, least(n.h, coalesce(m.n, 0)) AS k FROM n LEFT JOIN n m ON n.b = m.c
), r AS (
  SELECT k.c, t.pos AS d, said, words FROM k JOIN t ON t.c = k.b WHERE t.pos <= k.k
  UNION ALL SELECT k.c, t.pos - k.h + k.k, said, words FROM k JOIN t ON t.c = k.c WHERE t.pos > k.h
), p AS (
  SELECT c, d, words, list(said) OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, 0, [] FROM n
), v AS (
  SELECT path, d, min(c) AS m, count(*) AS n, any_value(words) AS words FROM p GROUP BY path, d
), f AS (
  SELECT p.c, p.d, v.m, v.n, v.words FROM p JOIN v ON p.path = v.path AND p.d = v.d
), u AS (
  SELECT v.m, v.d, v.n, v.words, a.m AS parent FROM v LEFT JOIN f a ON a.c = v.m AND a.d = v.d - 1
), q AS (
  SELECT u.*, coalesce(z.k, 0) AS kids FROM u LEFT JOIN (SELECT parent, d - 1 AS d, count(*) AS k FROM u WHERE d > 0 GROUP BY ALL) z ON z.parent = u.m AND z.d = u.d
), s AS (
  SELECT a.m, a.d, count(*) FILTER (q.kids = 0) AS leaves, sum((q.n - 1) * q.words) AS saved FROM q JOIN f a ON a.c = q.m AND a.d <= q.d GROUP BY a.m, a.d
), e AS (
  SELECT m, d, string_agg(c, ',' ORDER BY c) AS ids FROM f JOIN (SELECT c AS cc, max(d) AS dd FROM p GROUP BY c) ON c = cc AND d = dd GROUP BY m, d
)
SELECT q.m AS conv_id, CAST(q.d AS BIGINT) AS depth, q.parent AS parent_conv_id, q.n AS n_convs, CAST(q.kids AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM q JOIN s ON q.m = s.m AND q.d = s.d LEFT JOIN e ON q.m = e.m AND q.d = e.d
"""


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.damaged(spelling.runs(table(spark, sf_dir, "documents")))
    return spelling.group_variants(spelling.word_counts(words)).select("word", "form", "root", "n", "n_near", "form_n")


ORACLES["op12_spelling"] = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL
), h AS (
  SELECT run, n, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM r, {CRC_TABLE}
), d AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), s AS (
  SELECT DISTINCT word, n, length(word) AS l, word[:i - 1] || word[i + 1:] AS short FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word, b.word AS near, b.n FROM s a JOIN s b ON a.short = b.short AND a.l = b.l AND a.word <> b.word
  WHERE len(list_filter(range(1, a.l + 1), lambda i: a.word[i] <> b.word[i])) = 1
  UNION SELECT a.word, b.word, b.n FROM w a JOIN s b ON a.word = b.short
  UNION SELECT b.word, a.word, a.n FROM w a JOIN s b ON a.word = b.short
), g AS (
  SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY word
), m AS (
  SELECT p.word, min(p.near) AS near FROM p JOIN g ON p.word = g.word AND p.n = g.top GROUP BY p.word
), t AS (
  SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.top >= 2 * w.n THEN g.top END AS form_n, CASE WHEN g.top >= 2 * w.n THEN m.near END AS form
  FROM w LEFT JOIN g ON w.word = g.word LEFT JOIN m ON w.word = m.word
), f AS (
  SELECT word, word AS root, 0 AS steps FROM t
  UNION ALL SELECT f.word, t.form, steps + 1 FROM f JOIN t ON f.root = t.word WHERE t.form IS NOT NULL
)
SELECT t.word, t.form, l.root, t.n, t.n_near, t.form_n FROM t JOIN (SELECT word, arg_max(root, steps) AS root FROM f GROUP BY word) l ON t.word = l.word
"""
