"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tavola.llm import alignment, bpe, chatlog, langid, minhash, mixing, nndescent, pii, prefixtrie, projections, styletree, toxicity, viterbi
from tavola.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

BPE_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECES_FILE = public_tokenizers.path("piece_bpe_32k.model")


@query("op4_token_counts")
def op4_token_counts(spark, folder):
    docs = table(spark, folder, "documents")
    return viterbi.count_tokens(docs, PIECES_FILE).select(
        "doc_id", "n_tokens", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars")
    )


@query("op6_bpe")
def op6_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.bpe_encode(docs, BPE_FILE).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


#: The tables have no domain column; a source's number gives one of four.
DOMAIN_OF_SOURCE = "concat('domain', try_cast(regexp_extract(source, '([0-9]+)', 1) AS INT) % 4)"
DOMAIN_SQL = "'domain' || (TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 4)"
WEIGHTS = [{"domain0": 4, "domain1": 3, "domain2": 2}, {"en": 5, "de": 2, "fr": 2}, {"src0": 3}]
MIX = {"share": (1, 2), "max_epochs": 3, "seed": 1}


@query("op5_mix", mixing.mix_sql({"domain": DOMAIN_SQL, "lang": "lang", "source": "source"}, WEIGHTS, **MIX))
def op5_mix(spark, folder):
    docs = table(spark, folder, "documents")
    levels = {"domain": F.expr(DOMAIN_OF_SOURCE), "lang": F.col("lang"), "source": F.col("source")}
    taken = mixing.mix(docs, levels, WEIGHTS, **MIX)
    return taken.select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_epoch", "mix_tokens")


#: A stand-in; a deployment passes its own secret.
PII_KEY = "example key"


@query("op7_pii")
def op7_pii(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY)


@query("op9_toxicity")
def op9_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    share = toxicity.bucket(F.col("doc_id"), 5)
    model = toxicity.fit(docs, table(spark, folder, "labels"), share != 0)
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(share == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op2_minhash")
def op2_minhash(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_main_text")
def op10_main_text(spark, folder):
    return styletree.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op3_language")
def op3_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    share = langid.bucket(F.col("doc_id"), 3)
    model = langid.fit(docs, share != 1)
    held_out = F.coalesce(share == 1, F.lit(False)).alias("held_out")
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score", "rejected")


#: Cosines of all pairs with equal labels; components by the smallest vector reachable.
OP1_SQL = """
WITH RECURSIVE ok AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id,
  least(e.vec_id, coalesce(low.b, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN links ON e.vec_id = links.a LEFT JOIN low ON e.vec_id = low.a
"""


@query("op1_projections", OP1_SQL)
def op1_projections(spark, folder):
    return projections.near_duplicates(table(spark, folder, "embeddings"))


@query("op8_nearest")
def op8_nearest(spark, folder):
    return nndescent.nearest(table(spark, folder, "embeddings"))


#: What conversation -7 says in both of its turns.
CONTROLS = "\\### Assistant: </turn> ok"
OP11_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROLS}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROLS}'),
escaped AS (SELECT *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>') AS body FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 1 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op11_chat", OP11_SQL)
def op11_chat(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROLS).alias("text"),
    )
    made = chatlog.format_log(chatlog.turn_log(rows.unionByName(fixed)))
    return made.select("conv_id", chatlog.read_back("formatted", "loss").alias("r")).select("conv_id", "r.*")


#: CRC-32 of a decimal, bit by bit: DuckDB has no function for it.
CRC_SQL = """xor(list_reduce([4294967295] || list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""
OP12_SQL = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT c, {CRC_SQL.format(id='c')} % 9 AS h FROM own),
rebuilt AS (
  SELECT convs.c, 0 AS part, i, role, text FROM convs JOIN own ON own.c = convs.c - convs.c % 5 AND i <= h
  UNION ALL SELECT convs.c, 1, i, role, text FROM convs JOIN own ON own.c = convs.c AND i > h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, text,
    md5(length(role) || ':' || role || text) AS item FROM rebuilt),
paths AS (SELECT c, d, text, string_agg(item, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS p FROM turns
  UNION ALL SELECT c, 0, '', '' FROM convs),
len AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(text) AS text,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '') AS last FROM paths JOIN len USING (c) GROUP BY p, d),
kids AS (SELECT left(p, 32 * (CAST(d AS INTEGER) - 1)) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
subtree AS (SELECT above.p, count(*) FILTER (WHERE below.n_children = 0) AS n_leaves,
    sum((below.n_convs - 1) * strlen(below.text)) AS saved_tokens
  FROM known below, LATERAL (SELECT unnest(range(0, below.d + 1)) AS k), known above
  WHERE above.d = k AND above.p = left(below.p, 32 * CAST(k AS INTEGER)) GROUP BY above.p)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.last) AS ends_sha256
FROM known n JOIN subtree USING (p) LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = left(n.p, 32 * (CAST(n.d AS INTEGER) - 1))
"""


@query("op12_trie", OP12_SQL)
def op12_trie(spark, folder):
    return prefixtrie.trie(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))


BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")


@query("op13_alignment")
def op13_alignment(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return alignment.alignment(docs, BYTE_FILE, PIECES_FILE, digest=True).withColumnRenamed("groups", "groups_sha256")
