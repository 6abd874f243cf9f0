"""Gate, evaluation and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.functions import text as T
from scholia_spark.functions import unicode as U
from scholia_spark.operators import gates as G
from scholia_spark.plans.base import query, table


@query("""WITH x AS (SELECT doc_id AS id, (doc_id % 100)::VARCHAR || '.5 and ' || (doc_id % 17 + 1) || ' of ' || (doc_id % 9 + 2) || ' in ' || 3 * doc_id AS draft, (doc_id % 100)::VARCHAR || '.52 ' || (doc_id % 13 + 1) || ' ' || (doc_id % 9 + 2) AS src FROM documents),
n AS (SELECT id, unnest(regexp_extract_all(draft, '\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?')) AS t, list_transform(regexp_extract_all(src, '\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?'), lambda v: v::DOUBLE) AS vs FROM x),
g AS (SELECT id, len(list_filter(vs, lambda d: abs(d - t::DOUBLE) <= 0.5::DOUBLE * pow(10.0::DOUBLE, -length(regexp_extract(t, '\\.(\\d+)', 1))) + 1e-9::DOUBLE OR abs(t::DOUBLE - d) <= 1e-9::DOUBLE OR abs(CASE WHEN t::DOUBLE > 1 THEN t::DOUBLE / 100 ELSE t::DOUBLE * 100 END - d) <= 1e-9::DOUBLE)) > 0 AS ok FROM n),
s AS (SELECT id, count(*)::INT AS numbers, count(*) FILTER (WHERE NOT ok)::INT AS ungrounded FROM g GROUP BY 1)
SELECT id, numbers, ungrounded, round(ungrounded / numbers, 6) AS share, CASE WHEN ungrounded / numbers > 0.4 THEN 'numeric_mismatch' ELSE 'pass' END AS verdict FROM s""")
def q13_summary_grounding(spark, d):
    """Q13, N1, N4."""
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    draft = F.concat(s(i % 100), F.lit(".5 and "), s(i % 17 + 1), F.lit(" of "), s(i % 9 + 2), F.lit(" in "), s(i * 3))
    source = F.concat(s(i % 100), F.lit(".52 "), s(i % 13 + 1), F.lit(" "), s(i % 9 + 2))
    return G.summary_grounding(table(spark, d, "documents").select(i.alias("id"), draft.alias("draft"), source.alias("source")))


_TOKENS = r"""list_filter(string_split_regex(lower(regexp_replace(regexp_replace({}, '(?i)^\s*(?:section\b|sec\.|§)\s*[:.\-]?\s*', ''), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda x: x <> '')"""
_RUN = "contains(' ' || array_to_string({0}, ' ') || ' ', ' ' || array_to_string(k, ' ') || ' ')"
_NUMBERS = r"regexp_extract_all({}, '\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?')"


@query(rf"""WITH w AS (SELECT doc_id AS id, text, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents), p AS (SELECT unnest([1, 2, 3, 4]) AS pos),
a AS (SELECT id, pos, 'f' || pos % 2 AS field, array_to_string(ws[2 * pos - id % 2 : 2 * pos - id % 2 + 2], ' ') AS label, array_to_string(ws[2 * pos : 2 * pos], ' ') AS target FROM w, p),
t AS (SELECT *, {_TOKENS.format('label')} AS lk, {_TOKENS.format('target')} AS hk FROM a),
l AS (SELECT id, pos AS ord, array_to_string(ws[3 * pos : 3 * pos + pos % 2], ' ') AS name FROM w, p WHERE id % 6 <> 0), l2 AS (SELECT *, {_TOKENS.format('name')} AS k FROM l), l3 AS (SELECT * FROM l2 WHERE len(k) > 0),
m AS (SELECT id, pos, arg_max(name, struct_pack(e := (k = lk OR k = hk)::INT, n := CASE WHEN k = lk OR k = hk THEN 0 ELSE len(k) END, o := -ord)) AS name FROM t JOIN l3 USING (id) WHERE {_RUN.format('lk')} OR {_RUN.format('hk')} GROUP BY 1, 2),
r AS (SELECT t.id, t.pos, t.field, CASE WHEN t.id IN (SELECT id FROM l3) THEN m.name ELSE t.label END AS found FROM t LEFT JOIN m USING (id, pos)),
mi AS (SELECT id, count(*) AS missing FROM r WHERE found IS NULL GROUP BY 1), o AS (SELECT id, field, found, min(pos) AS pos FROM r WHERE found IS NOT NULL GROUP BY 1, 2, 3), ke AS (SELECT id, list(field || ':' || found ORDER BY pos) AS kept FROM o GROUP BY 1),
n AS (SELECT id, unnest({_NUMBERS.format("(id % 100)::VARCHAR || '.5 of ' || id * 3")}) AS x, list_transform({_NUMBERS.format("coalesce(text || chr(10), '') || (CASE WHEN id % 3 = 0 THEN 'Fig ' || id * 3 || ' at ' || (id % 100) || '.52' ELSE '' END)")}, lambda v: replace(v, ',', '')::DOUBLE) AS vs FROM w),
g AS (SELECT id, avg((len(list_filter(vs, lambda s: abs(s - x::DOUBLE) <= 0.5::DOUBLE * pow(10.0::DOUBLE, -length(regexp_extract(x, '\.(\d+)', 1))) + 1e-9::DOUBLE OR abs(CASE WHEN x::DOUBLE > 1 THEN x::DOUBLE / 100 ELSE x::DOUBLE * 100 END - s) <= 1e-9::DOUBLE)) = 0)::INT) AS share FROM n GROUP BY 1),
h AS (SELECT w.id, list_filter([CASE WHEN w.id % 7 = 0 THEN 'empty' END, CASE WHEN w.id % 5 = 0 THEN 'truncated' END, CASE WHEN w.id % 4 = 0 THEN 'schema_incomplete' END, CASE WHEN share > 0.4 THEN 'numeric_mismatch' END], lambda v: v IS NOT NULL) AS hard FROM w JOIN g USING (id))
SELECT id, CASE WHEN len(hard) > 0 THEN 'abstain' ELSE 'pass' END AS outcome, list_concat(hard, list_transform(range(coalesce(missing, 0)), lambda v: 'anchor_missing')) AS violations, coalesce(kept, []) AS kept FROM h LEFT JOIN mi USING (id) LEFT JOIN ke USING (id)""")
def q13_summary_verdict(spark, d):
    """Q13 whole: anchors and locations are runs of each text's words, numbers are held against the whole text."""
    i, pos = F.col("doc_id"), F.col("pos")
    s = lambda c: c.cast("string")
    docs = table(spark, d, "documents").select(i.alias("id"), "text", "doc_id", F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "").alias("ws"))
    some = lambda at, n: F.array_join(F.slice("ws", at.cast("int"), n), " ")
    each = docs.withColumn("pos", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    anchors = each.select("id", "pos", F.concat(F.lit("f"), s(pos % 2)).alias("field"), some(2 * pos - i % 2, F.lit(3)).alias("label"), some(2 * pos, F.lit(1)).alias("target"))
    locations = each.where("id % 6 <> 0").select("id", pos.alias("ord"), some(3 * pos, (1 + pos % 2).cast("int")).alias("label"))
    parts = F.when(i % 4 == 0, F.create_map(F.lit("code"), F.lit("x"))).otherwise(F.create_map(F.lit("code"), F.lit("x"), F.lit("data"), F.lit("y")))
    caption = F.when(i % 3 == 0, F.array(F.concat(F.lit("Fig "), s(i * 3), F.lit(" at "), s(i % 100), F.lit(".52"))))
    drafts = docs.select("id", F.when(i % 7 == 0, " ").otherwise("t").alias("tldr"), F.lit("m").alias("method"), F.concat(s(i % 100), F.lit(".5 of "), s(i * 3)).alias("results"), (i % 5 == 0).alias("truncated"), parts.alias("reproducibility"), F.col("text").alias("body"), caption.alias("captions"))
    return G.summary_verdict(drafts, anchors, locations)


@query("""WITH c AS (SELECT CASE WHEN quality = 1 THEN 'pass' ELSE 'block' END AS expected, (doc_id * 37 % 100) / 100.0::DOUBLE AS share FROM labels), t AS (SELECT unnest([0.2, 0.4, 0.6]::DOUBLE[]) AS threshold)
SELECT threshold, count(*) FILTER (WHERE expected = 'pass' AND share <= threshold) AS true_pass, count(*) FILTER (WHERE expected = 'block' AND share <= threshold) AS false_pass,
 count(*) FILTER (WHERE expected = 'block' AND share > threshold) AS true_block, count(*) FILTER (WHERE expected = 'pass' AND share > threshold) AS false_block FROM c, t GROUP BY 1""")
def a13_threshold_sweep(spark, d):
    """A12, A13."""
    cases = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "pass").otherwise("block").alias("expected"), (F.col("doc_id") * 37 % 100 / 100.0).alias("share"))
    return G.threshold_sweep(cases, [0.2, 0.4, 0.6])


@query("""WITH s AS (SELECT doc_id // 5 AS answer_id, doc_id % 7 <> 0 AS refs_ok, doc_id % 41 <> 0 AS papers_known, doc_id % 11 <> 0 AS numbers_ok, doc_id % 3 <> 0 AS cited FROM documents),
a AS (SELECT answer_id, count(*) AS n, count(*) FILTER (WHERE cited AND refs_ok AND numbers_ok) AS kept, count(*) FILTER (WHERE cited AND NOT (refs_ok AND numbers_ok)) AS demoted, count(*) FILTER (WHERE NOT papers_known) AS unknown FROM s GROUP BY 1)
SELECT answer_id, n, kept, demoted, CASE WHEN unknown > 0 THEN 'A3' WHEN kept = 0 THEN 'A4' WHEN (n - kept) / n > 0.5 THEN 'A5' ELSE 'ok' END AS code FROM a""")
def q16_answer_checks(spark, d):
    i = F.col("doc_id")
    return G.answer_checks(table(spark, d, "documents").select(F.expr("doc_id div 5").alias("answer_id"), (i % 7 != 0).alias("refs_ok"), (i % 41 != 0).alias("papers_known"), (i % 11 != 0).alias("numbers_ok"), (i % 3 != 0).alias("cited")))


@query("""WITH r AS (SELECT doc_id AS request_id, unnest([CASE WHEN doc_id % 2 = 0 THEN 'doi:' || doc_id % 50 END, 'arxiv:' || doc_id % 70, 'title:' || doc_id % 30]) AS k FROM documents),
s AS (SELECT doc_id AS state_id, CASE doc_id % 3 WHEN 0 THEN 'doi:' || doc_id % 40 WHEN 1 THEN 'arxiv:' || doc_id % 60 ELSE 'title:' || doc_id % 20 END AS k, doc_id % 3 AS b FROM documents)
SELECT request_id, arg_min(state_id, struct_pack(b := b, s := state_id)) AS state_id FROM (SELECT DISTINCT * FROM r) JOIN s USING (k) GROUP BY 1""")
def j2_lookup_by_keys(spark, d):
    """J2, J4, U4."""
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    c = lambda p, n: F.concat(F.lit(p), (i % n).cast("string"))
    req = docs.select(i.alias("request_id"), "doc_id")
    stored = docs.select(i.alias("state_id"), F.when(i % 3 == 0, c("doi:", 40)).when(i % 3 == 1, c("arxiv:", 60)).otherwise(c("title:", 20)).alias("k"), (i % 3).alias("b"))
    return G.lookup_by_keys(req, [F.when(i % 2 == 0, c("doi:", 50)), c("arxiv:", 70), c("title:", 30)], stored, "k", F.col("b"))


@query("SELECT 'p' || doc_id || 'v' || (doc_id % 3 + 1) AS paper_id, doc_id % 10 = 0 AS retracted FROM documents")
def f14_mark_retracted(spark, d):
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    items = docs.select(F.concat(F.lit("p"), i.cast("string"), F.lit("v"), (i % 3 + 1).cast("string")).alias("paper_id"))
    return G.mark_retracted(items, docs.where("doc_id % 10 = 0").select(F.concat(F.lit("p"), i.cast("string"), F.lit("v9")).alias("paper_id")))


@query("""SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g') AS text, '[REDACTED]' AS api_key FROM documents""")
def f17_redact(spark, d):
    tags = G.redact_keys(F.create_map(F.lit("api_key"), F.col("source")))
    return table(spark, d, "documents").select("doc_id", G.redact(F.col("text")).alias("text"), F.element_at(tags, "api_key").alias("api_key"))


@query("""WITH l AS (SELECT lang AS query_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id)::INT AS pos, doc_id AS id FROM documents)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, source)::INT AS out FROM l""")
def u2_interleave(spark, d):
    from scholia_spark.operators.ordering import places

    docs = table(spark, d, "documents").select(F.col("lang").alias("query_id"), "source", F.col("doc_id").alias("id"))
    return G.interleave(places(docs, ["query_id", "source"], [F.col("id")], "pos"))


@query("""SELECT answer_id, ord, conflicts, row_number() OVER (PARTITION BY answer_id ORDER BY (conflicts = 0)::INT, ord)::INT AS place FROM (SELECT doc_id % 40 AS answer_id, doc_id AS ord, doc_id % 3 AS conflicts FROM documents)""")
def s8_conflict_first(spark, d):
    i = F.col("doc_id")
    return G.conflict_first(table(spark, d, "documents").select((i % 40).alias("answer_id"), i.alias("ord"), (i % 3).alias("conflicts")))


@query("""WITH c AS (SELECT doc_id AS id, source AS category, round(log10(n_chars + 10) + (doc_id % 5) * 1.5::DOUBLE, 6) AS score FROM documents), r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY score DESC, id) <= 15 THEN 0 ELSE 1 END AS tier FROM c)
SELECT id, category, score, tier FROM r ORDER BY tier, score DESC, id LIMIT 100""")
def s10_capped_selection(spark, d):
    """A top-k report."""
    score = F.round(G.foundational_score(F.col("n_chars"), F.col("doc_id") % 5), 6)
    return G.capped_selection(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), score.alias("score")), 100)


@query("""WITH r AS (SELECT doc_id % 60 AS answer_id, doc_id // 60 AS n, CASE WHEN doc_id // 60 % 4 = 0 THEN 'conflict' ELSE 'support' END AS side, doc_id % 7 AS paper_id FROM documents)
SELECT a.answer_id, a.n, list_sort(list(DISTINCT b.n)) AS conflicts_with FROM r a JOIN r b ON a.answer_id = b.answer_id AND a.paper_id = b.paper_id AND a.side = 'conflict' AND b.side = 'support' AND a.n <> b.n GROUP BY ALL""")
def g1_conflict_map(spark, d):
    i = F.col("doc_id")
    return G.conflict_map(table(spark, d, "documents").select((i % 60).alias("answer_id"), F.expr("doc_id div 60").alias("n"), F.when(F.expr("doc_id div 60 % 4 = 0"), "conflict").otherwise("support").alias("side"), (i % 7).alias("paper_id")))


@query("""WITH e AS (SELECT doc_id % 90 AS paper_id, count(*) AS expected FROM documents GROUP BY 1), i AS (SELECT doc_id % 90 AS paper_id, count(*) AS indexed FROM documents WHERE doc_id % 90 < 80 AND doc_id % 13 <> 0 GROUP BY 1)
SELECT paper_id, expected, indexed, indexed IS NULL AS missing FROM e LEFT JOIN i USING (paper_id) WHERE indexed IS NULL OR indexed <> expected""")
def j12_stale_chunks(spark, d):
    p = table(spark, d, "documents").select((F.col("doc_id") % 90).alias("paper_id"), "doc_id")
    return G.stale_chunks(p.where("paper_id < 80 AND doc_id % 13 <> 0"), p)


@query("SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS q FROM documents")
def x2_nfc(spark, d):
    return table(spark, d, "documents").select("doc_id", U.nfc_query("text").alias("q"))


@query()
def x3_casefold_n3_forms(spark, d):
    """X3, N3."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", U.saved_query("text").alias("q"), F.explode(T.evidence_numbers(F.col("text"))).alias("number")).select("doc_id", "q", "number", U.number_forms("number").alias("forms"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def a4_representative(spark, d):
    """A4, J11, G8."""
    return G.first_by(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 AND doc_id % 4 <> 0 THEN 'abstract' WHEN doc_id % 3 = 2 THEN 'full_text' WHEN doc_id % 3 = 1 THEN 'abstract' ELSE 'none' END AS scope FROM documents")
def q15_scope_clamp(spark, d):
    i = F.col("doc_id")
    claimed = F.element_at(F.array(F.lit("none"), F.lit("abstract"), F.lit("full_text")), (i % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", G.scope_clamp(claimed, F.when(i % 4 == 0, "full_text").otherwise("abstract")).alias("scope"))


@query("""WITH c AS (SELECT CASE quality WHEN 1 THEN 'pass' ELSE 'block' END AS expected, CASE WHEN doc_id % 7 = 0 THEN 'abstain' WHEN (doc_id * 37 % 100) < 60 THEN 'pass' ELSE 'block' END AS got FROM labels)
SELECT count(*) AS cases, count(*) FILTER (WHERE expected = got) AS passed, count(*) FILTER (WHERE expected <> 'pass' AND got = 'pass') AS fabrications, count(*) FILTER (WHERE got = 'abstain') AS abstained FROM c""")
def a14_eval_roll_up(spark, d):
    i = F.col("doc_id")
    got = F.when(i % 7 == 0, "abstain").when(i * 37 % 100 < 60, "pass").otherwise("block")
    return G.eval_roll_up(table(spark, d, "labels").select(F.when(F.col("quality") == 1, "pass").otherwise("block").alias("expected"), got.alias("got")))


@query("SELECT l_partkey AS paper_id, count(DISTINCT l_suppkey) AS votes FROM lineitem GROUP BY 1")
def a15_survey_votes(spark, d):
    """Suppliers stand for surveys, parts for the papers they cite."""
    return G.survey_votes(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("survey_id"), F.col("l_partkey").alias("paper_id")))


@query("""SELECT doc_id AS id, unnest(list_distinct(list_filter(['r' || (doc_id % 9), 'a "b" ' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'deep' || (doc_id % 3) END], lambda x: x IS NOT NULL))) AS record_ref FROM documents""")
def g20_record_refs(spark, d):
    """References in objects, lists and beside other keys."""
    i = F.col("doc_id")
    refs = lambda c: F.struct(c.alias("recordRef"))
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    deep = F.array(F.struct(F.array(refs(F.when(i % 2 == 0, s("deep", i % 3))), refs(F.lit(""))).alias("list"), F.col("text").alias("recordRefs")))
    payload = F.to_json(F.struct(s("r", i % 9).alias("recordRef"), refs(s('a "b" ', i)).alias("of"), deep.alias("all")))
    return G.record_refs(table(spark, d, "documents").select(i.alias("id"), payload.alias("payload")))
