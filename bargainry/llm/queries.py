"""The operators over their whole tables: QUERIES, and ORACLE_SQL where DuckDB can say the same."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, bpe, chat, exact_dedup, fingerprint, mixing, near_dedup, pivots, prefix_trie, quality, sharding, substring_dedup, toxicity
from .common import WORD, table

#: Where the public tokenizers' files are, by name.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.compare_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), sharding.tree(24), sharding.tree(25))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.decide(table(spark, sf_dir, "documents"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


#: What conversation -1 says in both of its rows.
PROBE = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"),
    )
    probe = probe.select("conv_id", "t.turn", "t.role", F.lit(PROBE).alias("text"))
    out = chat.format_paths(chat.linear(rows.unionByName(probe)))
    out = out.withColumn("turns", chat.read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return out.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), back="decoded")
    told = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(told, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit_or_none(docs, table(spark, sf_dir, "labels"), "toxic"))
    return out.select("doc_id", "severity", "grade", (F.col("grade") > 0).alias("toxic"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), weighted=True).select("doc_id", "class_id", "class_size", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    out = quality.score(docs, quality.fit(docs, labels))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return pivots.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lengths = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    rows, lengths = prefix_trie.with_heads(rows, lengths, conv - conv % 20, F.crc32(conv.cast("string")) % 4, most=3)
    return prefix_trie.trie(rows, lengths)


QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_sharding": op2_sharding,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_chat": op5_chat,
    "op6_bpe": op6_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_top_k": op12_top_k,
    "op13_prefix_trie": op13_prefix_trie,
}


def _escaped_sql(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for plain, coded in chat.CONTROL.items():
        out = f"replace({out}, '{plain}', '{coded}')"
    return out


def _whole_sql(scale: int, where: str = "true", label: str = "label") -> str:
    return f"""
        SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE {where} AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


ORACLE_SQL = {
    "op11_hard_negatives": f"""
        WITH e AS ({_whole_sql(256, "label IS NOT NULL", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")}),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
              FROM e a JOIN e c ON a.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM a.vec_id AND len(c.v) = len(a.v)),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) <= 5),
        n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank
              FROM p JOIN s USING (anchor_id)
              WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op12_top_k": f"""
        WITH e AS ({_whole_sql(1024)}),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(c.v) = len(q.v)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
                   len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, k, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos FROM t),
        convs AS (SELECT c, count(*) AS n FROM o GROUP BY c),
        crc AS (SELECT c, xor(4294967295, list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT for x in string_split(CAST(c AS VARCHAR), '')],
                    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 4 AS h FROM convs),
        plan AS (SELECT c, h, c - c % 20 AS base, least(h, coalesce(b.n, 0)) AS taken FROM crc LEFT JOIN (SELECT c AS base_c, n FROM convs) b ON b.base_c = c - c % 20),
        r AS (SELECT plan.c, pos AS depth, k, words FROM plan JOIN o ON o.c = plan.base AND pos <= h
              UNION ALL SELECT plan.c, pos - h + taken, k, words FROM plan JOIN o ON o.c = plan.c AND pos > h),
        p AS (SELECT c, depth, words, list(k) OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM r
              UNION ALL SELECT c, 0, 0, [] FROM convs),
        lens AS (SELECT c, max(depth) AS size FROM p GROUP BY c),
        nodes AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                         sha256(coalesce(string_agg(CASE WHEN size = depth THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
                  FROM p JOIN lens USING (c) GROUP BY path, depth),
        kids AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, kids.n IS NULL AS leaf, (n_convs - 1) * words AS saved FROM nodes LEFT JOIN kids USING (path)),
        subtree AS (SELECT path[:top] AS path, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS top FROM own) GROUP BY 1)
        SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(own.n_convs AS BIGINT) AS n_convs, CAST(own.n_children AS BIGINT) AS n_children,
               CAST(subtree.leaves AS BIGINT) AS n_leaves, CAST(subtree.saved AS BIGINT) AS saved_tokens, own.ends_sha256
        FROM own JOIN subtree USING (path) LEFT JOIN own up ON own.depth > 0 AND up.path = own.path[:own.depth - 1]""",
    "op3_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
               CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM n""",
    "op5_chat": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST({len(chat.BEGIN)} + sum({len(chat.ROLE) + len(chat.ROLE_END) + len(chat.TURN_END)}
                    + length({_escaped_sql("role")}) + length({_escaped_sql("text")})) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op7_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
        w AS (SELECT doc_id, pos, words[pos:pos + 12] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM d)),
        owned AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) AS owner FROM w),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM owned WHERE owner < doc_id),
        word AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS body FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
}
