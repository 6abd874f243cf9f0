"""The queries opN_<name> and their SQL.

Each applies its operator to the whole table; the cases that the operator's module defines (nulls, empty and very long
texts, repeated rows, empty tables, extra columns) hold for its query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from scholia_spark.llm import bpe, chat, decontaminate, jaccard, licenses, lm, media, merkle, quality, search, sharding, toxicity, warc
from scholia_spark.llm.shared import table


def vocabulary() -> str:
    """Path of the public vocabulary file on the driver; workers get its bytes."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; null and empty texts get the score of the bias alone."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of every document; a null text is the empty one."""
    return bpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary())


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted text, of every conversation and of conversation -1; null texts are empty."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(rows.union(more))


def op4_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from each document's AVI file, and its timed clips; a null text is the empty one."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; texts without words link with nothing."""
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written archives hold of each page; a null html is an empty payload."""
    return warc.archive_index(warc.write_archives(table(spark, sf_dir, "pages")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of document and benchmark item that it leaks; null texts and items leak nothing."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the model of order 3 of the training fold; a null text is the end token alone."""
    return lm.lm_scores(table(spark, sf_dir, "documents"), order=3)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match of a licence template in a document, with coverage and span; null texts match nothing."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, equal texts together; a null text has 8 bytes."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 24)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item; null texts are never found."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentence's place and score of every document; texts without a word score 0."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof digest and verification of every document; nulls are ``-``."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_nbsvm, op2_bpe, op3_chat_format, op4_avi_mjpeg, op5_ngram_jaccard_join,
    op6_warc_zstd, op7_decontaminate, op8_kneser_ney, op9_license_scan, op10_vector_bin_packing,
    op11_ranked_search, op12_toxicity_mil, op13_merkle_manifest,
)
QUERIES = {f.__name__: f for f in _ALL}
_CONTROL = "|".join(sorted((c.replace("[", "\\[") for c in chat.Template().control), key=len, reverse=True))
_OP3 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '{_CONTROL}')) AS n,
 length(role) + length(role) - length(replace(role, chr(92), '')) + len(regexp_extract_all(role, '{_CONTROL}')) AS rn,
 lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS ends FROM c),
o AS (SELECT *, CASE WHEN said IS NULL THEN role IN ('system', 'user') WHEN said = 'system' THEN role = 'user' WHEN said = 'user' THEN role = 'assistant' WHEN said = 'assistant' THEN role = 'user' ELSE false END AS fine FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum(n + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 28 + rn END)::BIGINT AS formatted_chars, bool_and(fine) AND bool_or(ends AND role = 'assistant') AS valid FROM o GROUP BY 1"""
_OP5 = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.node = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.node) AS component_id FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1"""
_OP6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_OP11 = f"""WITH t AS (SELECT doc_id, {_TERMS} AS w, row_number() OVER () AS r FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM t WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY term, docs),
p AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS part FROM tf JOIN df USING (term), s),
h AS (SELECT item_id, r, doc_id, sum(part)::BIGINT AS score FROM p JOIN q USING (term) WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM h WHERE score > 0) WHERE rank <= 50"""
_OP13 = """WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, coalesce('s' || source, '') AS grp, doc_id, text, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
 list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS crc FROM documents),
f AS (SELECT r, grp, doc_id, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf, CASE WHEN crc % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS t, head FROM e),
b AS (SELECT r, grp, doc_id, leaf, sha256(head || coalesce(strlen(t)::VARCHAR || ':' || t, '-')) AS tampered, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM f),
lo(grp, lvl, idx, d, n) AS (SELECT grp, 0, idx, leaf, n FROM b UNION ALL SELECT grp, lvl + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), (n + 2) // 3 FROM lo WHERE n > 1 GROUP BY grp, lvl, idx // 3, n),
u AS (SELECT grp, d AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM lo WHERE n = 1),
hi(lvl, idx, d, n) AS (SELECT 0, idx, subroot, n FROM u UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), (n + 2) // 3 FROM hi WHERE n > 1 GROUP BY lvl, idx // 3, n),
a AS (SELECT grp, lvl, idx, d, n FROM lo UNION ALL SELECT NULL, lvl, idx, d, n FROM hi),
s AS (SELECT x.grp, x.lvl, x.idx, coalesce(string_agg(y.d, '' ORDER BY y.idx) FILTER (WHERE y.idx < x.idx), '') AS l, coalesce(string_agg(y.d, '' ORDER BY y.idx) FILTER (WHERE y.idx > x.idx), '') AS rt
 FROM a x JOIN a y ON x.grp IS NOT DISTINCT FROM y.grp AND x.lvl = y.lvl AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY ALL),
p1(r, grp, lvl, idx, d, sib) AS (SELECT r, grp, 0, idx, tampered, '' FROM b UNION ALL SELECT p1.r, p1.grp, p1.lvl + 1, p1.idx // 3, sha256(l || d || rt), sib || l || rt FROM p1 JOIN s ON s.grp = p1.grp AND s.lvl = p1.lvl AND s.idx = p1.idx),
t1 AS (SELECT r, grp, arg_max(d, lvl) AS d, arg_max(sib, lvl) AS sib FROM p1 GROUP BY ALL),
p2(r, lvl, idx, d, sib) AS (SELECT t1.r, 0, u.idx, t1.d, t1.sib FROM t1 JOIN u USING (grp) UNION ALL SELECT p2.r, p2.lvl + 1, p2.idx // 3, sha256(l || d || rt), sib || l || rt FROM p2 JOIN s ON s.grp IS NULL AND s.lvl = p2.lvl AND s.idx = p2.idx),
t2 AS (SELECT r, arg_max(d, lvl) AS d, arg_max(sib, lvl) AS sib FROM p2 GROUP BY ALL), root AS (SELECT d AS root FROM hi WHERE n = 1)
SELECT b.doc_id, b.leaf, u.subroot, root.root, sha256(t2.sib) AS proof_sha256, t2.d AS folded_root, t2.d = root.root AS verified FROM b JOIN t2 USING (r) JOIN u USING (grp), root"""
ORACLE_SQL: dict[str, str] = {"op3_chat_format": _OP3, "op5_ngram_jaccard_join": _OP5, "op6_warc_zstd": _OP6, "op11_ranked_search": _OP11, "op13_merkle_manifest": _OP13}
