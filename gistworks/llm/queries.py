"""The operators' registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gistworks.llm import bpe, chat, decontaminate, lines, lm, merkle, prefixes, quality, repeats, sharding, simhash, toxicity, wordpiece


#: Scores from which a text counts as toxic.
TOXIC = 0.7


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(_table(spark, folder, "documents"), path, pattern, form="digest")


def _fold(modulus: int):
    """crc32 of the identifier as text, modulo; a null identifier has none."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = wordpiece.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return wordpiece.count_pieces(_table(spark, folder, "documents"), vocabulary)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"), shingle=3, distance=3)


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(_table(spark, folder, "documents"), 40)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(docs, _table(spark, folder, "benchmark")).where("size(leaks) > 0")
    return found.select("doc_id", F.col("leaks.item_id").alias("item_ids"), F.array_max("leaks.common").alias("most_common"))


def op6_lines(spark: SparkSession, folder: str) -> DataFrame:
    made = lines.with_kept(_table(spark, folder, "documents"))
    return made.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.concat_ws(" ", "removed").alias("removed_lines"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.rate(docs, quality.fit(docs, _table(spark, folder, "labels")))


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(chat.format_chats(turns.unionByName(own)))


def train_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels that the toxicity classifier may learn from: all but one fold of three."""
    return _table(spark, folder, "labels").where(_fold(3) != 1)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.with_score(docs, toxicity.fit(docs, train_labels(spark, folder))).drop("text")
    held_out = F.coalesce(_fold(3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op10_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").withColumn("held_out", F.coalesce(_fold(7) == 2, F.lit(False)))
    return lm.score(docs, ~F.col("held_out"), keep={"held_out": "held_out"})


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves, proofs and what the proofs say of rows of which a fifth was tampered with."""
    docs = _table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf_digest([merkle.without_capitals(F.col(c)) if c == "text" else F.col(c) for c in fields])
    made, root = merkle.manifest(docs, fields, "source", "doc_id", F.when(_fold(5) == 0, tampered), "digest", {"doc_id": "doc_id"})
    top = F.lit(root).cast("string")
    return made.select("doc_id", "leaf", "subroot", top.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified"))


def op12_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, folder, "documents"), 50, form="digest")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie over conversations whose first 0 to 5 turns are those of their hundred's first."""
    turns, _ = prefixes.numbered(_table(spark, folder, "conversations"))
    return prefixes.trie(*prefixes.rebuilt(turns, lambda c: c - c % 100, lambda c: F.crc32(c.cast("string")) % 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_counts": op1_token_counts, "op2_simhash": op2_simhash, "op3_bpe": op3_bpe, "op4_sharding": op4_sharding, "op5_decontamination": op5_decontamination, "op6_lines": op6_lines, "op7_quality": op7_quality, "op8_chat": op8_chat, "op9_toxicity": op9_toxicity, "op10_lm": op10_lm, "op11_merkle": op11_merkle, "op12_repeats": op12_repeats, "op13_prefix_trie": op13_prefix_trie}


_CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, lag(role, 1, 'start') OVER w AS before, lead(role) OVER w IS NULL AS last,
    length(text) + length(regexp_replace(text, '[^\\\\<\\[]', '', 'g')) AS escaped,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 20 + length(role) + length(regexp_replace(role, '[^\\\\<\\[]', '', 'g')) END AS marks
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + marks)::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before = 'start' WHEN 'user' THEN before IN ('start', 'system', 'assistant')
    WHEN 'assistant' THEN before = 'user' ELSE false END AND (NOT last OR role = 'assistant')) AS valid
FROM marked GROUP BY conv_id
"""


def _descend_sql(shards: int) -> str:
    """Joins that go down the tree from ``keys`` level by level, as subqueries."""
    at = "SELECT rid, k, 0 AS node FROM keys"
    fan = -(-shards // sharding.SPANS[0])
    for level, span, below in zip(sharding.LEVELS, sharding.SPANS, (*sharding.SPANS[1:], 1)):
        count = -(-shards // span)
        at = f"""
          SELECT rid, any_value(k) AS k, arg_min(child, draw) AS node FROM (
            SELECT rid, k, child, -ln((('0x' || substr(md5('{level}' || child || ':' || k), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
              / (least({shards}, (child + 1) * {span}) - child * {span}) AS draw
            FROM (SELECT rid, k, node * {fan} + unnest(range({fan})) AS child FROM ({at})) WHERE child < {count}
          ) GROUP BY rid"""
        fan = span // below
    return at


_CRC_TABLE_SQL = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
)"""


def _crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, where ``crc_table`` is joined."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


_SHARD_SQL = f"""
WITH {_CRC_TABLE_SQL}, keys AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents
), sized AS (
  SELECT rid, doc_id, strlen(text) + 16 AS size,
    {_crc_sql("text")} AS text_crc32
  FROM keys, crc_table
), placed AS (
  SELECT s.*, a.node AS shard, b.node AS grown_shard
  FROM sized s JOIN ({_descend_sql(40)}) a USING (rid) JOIN ({_descend_sql(41)}) b USING (rid)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot
FROM placed
"""


def _leaf_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RISE_SQL = "list_transform(range((len(nodes) + 15) // 16), lambda k: sha256(array_to_string(nodes[k * 16 + 1:k * 16 + 16], '')))"
_MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE_SQL}, leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql(f"translate(text, {_CAPITALS})")} AS lowered,
    coalesce({_crc_sql("doc_id::VARCHAR")} % 5 = 0, false) AS tampered
  FROM documents, crc_table
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), levels AS (
  SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, level + 1, {_RISE_SQL} FROM levels WHERE len(nodes) > 1
), subroots AS (
  SELECT source, level, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM levels WHERE len(nodes) = 1
), crown AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, {_RISE_SQL} FROM crown WHERE len(nodes) > 1
), paths AS (
  SELECT l.source, l.level, l.nodes, false AS above FROM levels l WHERE len(l.nodes) > 1
  UNION ALL
  SELECT s.source, s.level + c.level, c.nodes, true FROM subroots s, crown c WHERE len(c.nodes) > 1
), steps AS (
  SELECT p.doc_id, p.source, p.pos, w.level, (CASE WHEN w.above THEN s.place >> (4 * (w.level - s.level)) ELSE p.pos >> (4 * w.level) END)::BIGINT AS own, w.nodes
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN paths w ON p.source IS NOT DISTINCT FROM w.source
), siblings AS (
  SELECT source, pos, level, array_to_string(nodes[(own // 16) * 16 + 1:own], '') AS before,
    array_to_string(nodes[own + 2:(own // 16) * 16 + 16], '') AS after FROM steps
), folded AS (
  SELECT source, pos, 0::BIGINT AS level, CASE WHEN tampered THEN lowered ELSE leaf END AS digest FROM placed
  UNION ALL
  SELECT f.source, f.pos, f.level + 1, sha256(g.before || f.digest || g.after)
  FROM folded f JOIN siblings g ON f.source IS NOT DISTINCT FROM g.source AND f.pos = g.pos AND f.level = g.level
), ends AS (
  SELECT source, pos, arg_max(digest, level) AS folded_root FROM folded GROUP BY source, pos
), proofs AS (
  SELECT source, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM siblings GROUP BY source, pos
)
SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
JOIN ends e ON p.source IS NOT DISTINCT FROM e.source AND p.pos = e.pos
LEFT JOIN proofs q ON p.source IS NOT DISTINCT FROM q.source AND p.pos = q.pos
CROSS JOIN (SELECT nodes[1] AS root FROM crown WHERE len(nodes) = 1) r
"""


_TRIE_SQL = f"""
WITH {_CRC_TABLE_SQL}, own AS (
  SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, length(coalesce(text, '')) AS len,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own), crc_table
), lists AS (
  SELECT conv_id, list(key ORDER BY pos) AS keys, list(len ORDER BY pos) AS lens FROM own GROUP BY conv_id
), whole AS (
  SELECT c.conv_id, coalesce(b.keys[1:h], []) || o.keys[h + 1:] AS keys, coalesce(b.lens[1:h], []) || o.lens[h + 1:] AS lens
  FROM convs c JOIN lists o USING (conv_id) LEFT JOIN lists b ON b.conv_id = c.base
), paths AS (
  SELECT conv_id, len(keys) AS n, d AS depth, md5(array_to_string(keys[1:d], ',')) AS node, md5(array_to_string(keys[1:d - 1], ',')) AS above, lens[d] AS len
  FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM whole)
), nodes AS (
  SELECT depth, node, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(coalesce(len, 0)) AS len,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM paths GROUP BY depth, node
), children AS (
  SELECT depth - 1 AS depth, above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), subtrees AS (
  SELECT p.depth, p.node, sum((x.n_convs - 1) * x.len) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes x JOIN paths p ON p.conv_id = x.conv_id AND p.depth <= x.depth LEFT JOIN children c ON c.depth = x.depth AND c.node = x.node
  GROUP BY p.depth, p.node
)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN subtrees s ON s.depth = x.depth AND s.node = x.node
LEFT JOIN nodes u ON x.depth > 0 AND u.depth = x.depth - 1 AND u.node = x.above
LEFT JOIN children c ON c.depth = x.depth AND c.node = x.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": _SHARD_SQL, "op8_chat": _CHAT_SQL, "op11_merkle": _MERKLE_SQL, "op13_prefix_trie": _TRIE_SQL}
