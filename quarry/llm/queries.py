"""The opN_ queries: thin callers of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, decontamination, exact_dedup, jaccard_join, line_dedup, mixing, pii, quality, sharding, simhash, spelling, token_files, vector_codes
from quarry.llm.common import ascii_lower, read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are labelled good and not toxic."""
    return read(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.rotate(read(spark, sf_dir, "conversations")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2(ascii_lower(F.col("text")), 256)})
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = token_files.write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(manifest)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "slot", "shard")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "words_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(read(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_files": op7_token_files,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_simhash": op11_simhash,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling": op13_spelling,
}

# the filled table itself is checked against a plain fill in tests; SQL looks it up
_SLOTS = ",".join(map(str, sharding.fill_table(sharding.SHARDS)))


def _codes_sql() -> str:
    """Rounds as a chain of WITH terms: a (assignment) by the codebooks c, then the codebooks of the next round."""
    nearest = "SELECT rid, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT rid, p.part, entry, list_sum(list_transform(list_zip(pv, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{k} c ON p.part = c.part) GROUP BY ALL"
    book = "SELECT c.part, c.entry, CASE WHEN s.cv IS NULL THEN c.cv ELSE s.cv END AS cv FROM c{j} c LEFT JOIN (SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS cv FROM (SELECT p.part, entry, i, sum(pv[i]) AS total, count(*) AS n FROM a{j} a JOIN p ON a.rid = p.rid AND a.part = p.part, unnest(range(1, len(pv) + 1)) AS u(i) GROUP BY ALL) GROUP BY ALL) s ON c.part = s.part AND c.entry = s.entry"
    steps = "".join(f", a{k} AS MATERIALIZED ({nearest.format(k=k)}), c{k + 1} AS MATERIALIZED ({book.format(j=k)})" for k in range(vector_codes.ROUNDS))
    last = vector_codes.ROUNDS
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rid, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS pv FROM v, unnest(range(16)) AS u(part)
), c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pv AS cv FROM p WHERE rid <= 64){steps}, a AS MATERIALIZED ({nearest.format(k=last)}), e AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a JOIN v USING (rid) GROUP BY rid, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) FROM (SELECT part, entry, unnest(cv) AS x, unnest(range(len(cv))) AS i FROM c{last})) AS codebooks_sha256
FROM e"""


# words hold no ASCII but a-z, so that each of the 64 code points above can stand for itself as another byte
_LETTERS, _BYTES = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(33, 97))).replace("'", "''")

ORACLE_SQL = {
    "op12_vector_codes": _codes_sql(),
    "op13_spelling": rf"""
WITH RECURSIVE d AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{6,}}')) AS run FROM documents
), r AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d GROUP BY ALL
), crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), x AS (
  SELECT run, n, hex(encode(id || ':' || run)) AS bytes FROM r
), h AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM x, crc
), w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{_LETTERS}', '{_BYTES}') AS bytes
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), near AS (
  SELECT a.word, b.word AS form, b.n FROM w a JOIN w b ON abs(length(a.bytes) - length(b.bytes)) <= 1 AND a.word <> b.word WHERE levenshtein(a.bytes, b.bytes) = 1
), f AS MATERIALIZED (
  SELECT w.word, w.n, count(o.form) AS n_near, first(o.form ORDER BY o.n DESC, o.form) AS form, max(o.n) AS form_n FROM w LEFT JOIN near o ON w.word = o.word GROUP BY w.word, w.n
), g AS MATERIALIZED (
  SELECT word, n, n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM f
), root AS (
  SELECT word, word AS here, 0 AS steps FROM g UNION ALL SELECT root.word, g.form, steps + 1 FROM root JOIN g ON root.here = g.word WHERE g.form IS NOT NULL
)
SELECT g.word, g.form, (SELECT arg_max(here, steps) FROM root WHERE root.word = g.word) AS root, g.n, g.n_near, g.form_n FROM g""",
    "op8_sharding": f"""
WITH t AS (SELECT string_split('{_SLOTS}', ',') AS owners), o AS (SELECT unnest(generate_series(0, len(owners) - 1)) AS slot, unnest(owners) AS owner FROM t),
d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(owner AS INTEGER) AS shard FROM d JOIN o USING (slot)""",
    "op4_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN length(trim(coalesce(role, ''))) > 0 THEN trim(role) ELSE 'unknown' END AS speaker, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t
), s AS (
  SELECT t.*, p.perspective, CASE WHEN t.speaker = p.perspective THEN '<|im_start|>assistant' || chr(10)
         ELSE '<|im_start|>user name=' || regexp_replace(t.speaker, '\s+', '_', 'g') || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), g AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM s
), o AS (
  SELECT *, row_number() OVER w AS seq, sum(length(segment)) OVER w - length(segment) AS start
  FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, CAST(start // 65536 AS BIGINT) AS part, count(*) AS n_turns, CAST(min(start) AS BIGINT) AS part_start,
       string_agg(segment, '' ORDER BY seq) AS text,
       coalesce(string_agg(CASE WHEN speaker = perspective THEN CAST(start + length(head) AS VARCHAR) || ':' || CAST(start + length(head) + length(text) AS VARCHAR) END, ',' ORDER BY seq), '') AS masks
FROM o GROUP BY conv_id, perspective, start // 65536""",
    "op6_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM s
), w AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, 2e0 * source_size AS cap FROM r
), o AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / weight, sid) - cap))
            / sum(weight) OVER (ORDER BY cap / weight DESC, sid DESC) AS level FROM w
), l AS (
  SELECT arg_min(level, cap / weight) AS level FROM o WHERE level <= cap / weight
), t AS (
  SELECT o.source, o.source_size, least(o.cap, coalesce(l.level * o.weight, o.cap)) AS target FROM o LEFT JOIN l ON true
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.doc_id, d.size, d.h, p.*, target - whole * source_size AS rest,
         sum(d.size) OVER (PARTITION BY p.source ORDER BY d.h) AS run, sum(d.size) OVER (PARTITION BY p.source, d.h) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN run <= rest OR (run - own <= rest AND run - rest < rest - (run - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c""",
}
