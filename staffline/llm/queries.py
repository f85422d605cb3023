"""One registered query for each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm.common import file_locator, shared_folder, table
from staffline.llm.conversation_repair import conversations, repair, repaired_sha256
from staffline.llm.decontaminate import contained_items
from staffline.llm.exact_dedup import exact_dedup
from staffline.llm.html_text import extract
from staffline.llm.language_id import fit as fit_languages
from staffline.llm.language_id import held_out, identify
from staffline.llm.language_model import fit as fit_language_model
from staffline.llm.language_model import score
from staffline.llm.merkle import FIELDS, folded_root, leaf_hash, manifest, witness_hash
from staffline.llm.packing import pack
from staffline.llm.simhash import near_duplicates
from staffline.llm.substring_dedup import repeated_passages
from staffline.llm.token_scan import named_counts, write_token_files
from staffline.llm.toxicity import fit as fit_toxicity
from staffline.llm.toxicity import toxicity
from staffline.llm.warc import page_of, read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return repeated_passages(spark, docs, locator=file_locator(docs))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    result = exact_dedup(spark, docs, file_locator(docs))
    return result.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(4, 2))
    model = fit_languages(spark, docs.where(~F.col("held_out")))
    return identify(spark, docs, model, ["doc_id", "held_out"])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_archives(spark, table(spark, sf_dir, "pages").withColumn("payload", F.col("html").cast("binary")), folder)
    records = read_archives(spark, folder, payloads=False).where("gap IS NULL")
    return records.select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to")
    )


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT hex, max(page_id) AS response_id FROM p GROUP BY hex
)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(p.hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)
  ), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id = g.response_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = g.response_id THEN NULL ELSE g.response_id END AS refers_to
FROM p JOIN g ON p.hex = g.hex
"""


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(7, 2))
    model = fit_language_model(spark, docs.where(~F.col("held_out")))
    return score(spark, docs, model, ["doc_id", "held_out"])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, scanned; each count has the doc_id that was written beside it."""
    folder = shared_folder(spark)
    write_token_files(spark, table(spark, sf_dir, "documents"), folder, name="doc_id")
    return named_counts(spark, folder).select(F.col("name").alias("doc_id"), "file", "doc_no", "start", "n_tokens")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contained_items(spark, docs, table(spark, sf_dir, "benchmark"), file_locator(docs))
    return found.select("doc_id", "item_id", "n_shingles", "n_common", "containment")


OP7_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')
  FROM benchmark
), shingles AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) >= 5
), sizes AS (
  SELECT id, count(*) AS n FROM shingles WHERE side = 'b' GROUP BY id
), common AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n
  FROM shingles d JOIN shingles b ON d.s = b.s AND d.side = 'd' AND b.side = 'b' GROUP BY ALL
)
SELECT c.doc_id, c.item_id, s.n::INTEGER AS n_shingles, c.n::INTEGER AS n_common, c.n::DOUBLE / s.n AS containment
FROM common c JOIN sizes s ON c.item_id = s.id WHERE c.n::DOUBLE / s.n >= 0.8
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    result = near_duplicates(spark, docs, file_locator(docs))
    return result.select("doc_id", "fingerprint", "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(5, 0))
    model = fit_toxicity(spark, docs.where(~F.col("held_out")), table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return toxicity(spark, docs, model, ["doc_id", "held_out"]).drop("clauses")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` as the contract damages them: rows dropped, emptied, cut short, repeated or said to be the user's."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    role = F.when(fault == 4, "user").otherwise(text["role"])
    now = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text["text"], "[.!?]", "")).otherwise(text["text"])
    times = F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))
    return turns.where(fault != 0).select("conv_id", "turn", role.alias("role"), now.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    audits, rows = repair(spark, damaged(turns))
    return conversations(turns, audits, repaired_sha256(rows, audits))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), coded AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS fault
  FROM told, crc
), lines AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM lines
), marked AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair
  FROM placed
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen THEN 'd' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM marked
), insertions(p, q, icost, letters, turns) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
    (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])
), edits AS (
  SELECT conv_id, pos, p, p AS q, 3 AS ecost, 'D' AS letter, []::VARCHAR[] AS turn FROM judged, (VALUES (0), (1), (2), (3)) s(p)
  UNION ALL
  SELECT conv_id, pos, p, q, (fault = 't')::INT, 'K', [role || ':' || text]
  FROM judged JOIN (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')) s(p, q, initial) ON role[1] = initial WHERE fault IN ('', 't')
  UNION ALL
  SELECT conv_id, pos, p, q, 2 + (fault = 't')::INT, 'R', [role2 || ':' || text]
  FROM judged, (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')) s(p, q, role2) WHERE fault IN ('', 't')
), ways AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS state, '0000000000' AS key, []::VARCHAR[] AS turns FROM judged GROUP BY conv_id
  UNION ALL
  SELECT w.conv_id, w.pos + 1, e.q, min(n.key), arg_min(list_concat(w.turns, list_concat(i.turns, e.turn)), n.key)
  FROM ways w JOIN insertions i ON w.state = i.p JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.pos = w.pos + 1 AND e.p = i.q,
    LATERAL (SELECT lpad((substr(w.key, 1, 10)::BIGINT + i.icost + e.ecost)::VARCHAR, 10, '0') || substr(w.key, 11) || i.letters || e.letter AS key) n
  GROUP BY w.conv_id, w.pos, e.q
), ended AS (
  SELECT w.conv_id, min(n.key) AS key, arg_min(list_concat(w.turns, i.turns), n.key) AS turns
  FROM ways w JOIN insertions i ON w.state = i.p AND i.q IN (0, 3) JOIN (SELECT conv_id, max(pos) AS n FROM judged GROUP BY conv_id) s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = s.n,
    LATERAL (SELECT lpad((substr(w.key, 1, 10)::BIGINT + i.icost)::VARCHAR, 10, '0') || substr(w.key, 11) || i.letters AS key) n
  GROUP BY w.conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(substr(key, 1, 10)::BIGINT, 0) AS cost, coalesce(substr(key, 11), '') AS audit,
  sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counted c ON ids.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON ids.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages"), ["page_id", "url"])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering deletes the line ends of a text."""
    untouched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 != 0
    tampered = leaf_hash(*(F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS))
    rows = manifest(spark, table(spark, sf_dir, "documents"), {"tampered": F.when(~untouched, tampered)})
    folded = folded_root(F.coalesce("tampered", "leaf"), F.col("witness"))
    checked = rows.withColumn("proof_sha256", witness_hash(F.col("witness"))).withColumn("folded_root", folded)
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS tree,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS f,
    coalesce(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)) & 1 = 1, false) AS tampered,
    replace(text, chr(10), '') AS cut
  FROM documents, crc
), leaves AS (
  SELECT row, doc_id, tree, sha256(array_to_string(f, '')) AS leaf,
    CASE WHEN tampered THEN sha256(array_to_string(f[:4], '') || coalesce(strlen(cut) || ':' || cut, '-')) ELSE sha256(array_to_string(f, '')) END AS later
  FROM d
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, rank AS idx, leaf AS digest, n FROM ranked
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n
), subroots AS (
  SELECT tree, digest, level, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, rank AS idx, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY level, idx // 3, n
), steps AS (
  SELECT a.tree, a.level, a.idx, string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx) AS before, string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx) AS after
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, a.level, a.idx, string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx)
  FROM upper a JOIN upper b ON a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
), path AS (
  SELECT row, tree, 0 AS level, rank AS idx, later AS node, '' AS proof FROM ranked
  UNION ALL
  SELECT p.row, p.tree, p.level + 1, p.idx // 3, sha256(coalesce(s.before, '') || p.node || coalesce(s.after, '')), p.proof || coalesce(s.before, '') || coalesce(s.after, '')
  FROM path p JOIN steps s ON p.tree = s.tree AND p.level = s.level AND p.idx = s.idx
), climb AS (
  SELECT p.row, 0 AS level, s.rank AS idx, p.node, p.proof FROM path p JOIN subroots s ON p.tree = s.tree AND p.level = s.level
  UNION ALL
  SELECT c.row, c.level + 1, c.idx // 3, sha256(coalesce(s.before, '') || c.node || coalesce(s.after, '')), c.proof || coalesce(s.before, '') || coalesce(s.after, '')
  FROM climb c JOIN steps s ON s.tree IS NULL AND c.level = s.level AND c.idx = s.idx
)
SELECT r.doc_id, r.leaf, s.digest AS subroot, u.digest AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = u.digest AS verified
FROM ranked r JOIN subroots s ON r.tree = s.tree JOIN upper u ON u.n = 1 JOIN climb c ON c.row = r.row AND c.level = u.level
"""


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_language_id": op3_language_id,
        "op4_warc": op4_warc,
        "op5_lm_score": op5_lm_score,
        "op6_token_counts": op6_token_counts,
        "op7_decontaminate": op7_decontaminate,
        "op8_simhash": op8_simhash,
        "op9_toxicity": op9_toxicity,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_html_extraction": op12_html_extraction,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op4_warc": OP4_SQL,
        "op7_decontaminate": OP7_SQL,
        "op11_conversation_repair": OP11_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
