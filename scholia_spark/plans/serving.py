"""Serving queries: scoped lists, pages, result states, turns, jobs and budgets over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.functions import ids
from scholia_spark.operators import serving as V
from scholia_spark.plans.base import query, table


def _s(c):
    return c.cast("string")


def _pick(i, *values):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


_IDS = """s AS (SELECT doc_id, ['arxiv:2101.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') || 'v3', '2101.' || lpad((doc_id % 100000)::VARCHAR, 5, '0'), 'doi:10.1234/x' || doc_id, 'userdoc:u' || doc_id, '10.1234/x' || doc_id, 'https://h/x' || doc_id][(doc_id % 6) + 1] AS ref FROM documents)"""


def _refs(spark, d):
    i = F.col("doc_id")
    num, n = F.concat(F.lit("2101."), F.lpad(_s(i % 100000), 5, "0")), _s(i)
    forms = F.array(F.concat(F.lit("arxiv:"), num, F.lit("v3")), num, F.concat(F.lit("doi:10.1234/x"), n), F.concat(F.lit("userdoc:u"), n), F.concat(F.lit("10.1234/x"), n), F.concat(F.lit("https://h/x"), n))
    return table(spark, d, "documents").select("doc_id", F.element_at(forms, (i % 6 + 1).cast("int")).alias("ref"))


@query(f"""WITH {_IDS} SELECT doc_id, CASE WHEN contains(ref, ':') AND split_part(ref, ':', 1) IN ('arxiv', 'doi', 'userdoc', 'attachment') THEN split_part(ref, ':', 1) END AS namespace,
regexp_extract(ref, '^(?:arxiv:)?(.+?)(?:v(\\d+))?$', 1) AS paper, TRY_CAST(regexp_extract(ref, '^(?:arxiv:)?(.+?)(?:v(\\d+))?$', 2) AS INT) AS version,
CASE WHEN doc_id % 6 = 0 THEN substr(ref, 7) WHEN doc_id % 6 = 1 THEN ref || 'v1' END AS versioned,
CASE doc_id % 6 WHEN 0 THEN 'ARXIV:' || regexp_replace(substr(ref, 7), 'v3$', '') WHEN 1 THEN 'ARXIV:' || ref WHEN 2 THEN 'DOI:' || substr(ref, 5) WHEN 4 THEN 'DOI:' || ref WHEN 5 THEN 'URL:' || ref ELSE ref END AS graph_id FROM s""")
def x12_x16_references(spark, d):
    """X12, X15, X16, G10."""
    r = F.col("ref")
    rec = ids.record_ref(r)
    return _refs(spark, d).select("doc_id", ids.namespace(r).alias("namespace"), rec["paper"].alias("paper"), rec["version"].alias("version"), ids.versioned_arxiv(r).alias("versioned"), ids.graph_paper_id(r).alias("graph_id"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'arxiv:2101.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') WHEN 1 THEN 'arxiv:' || doc_id ELSE 'doi:10.1/x' || doc_id END AS live_key, [0, 1, 2, 0][(doc_id % 4) + 1] AS priority FROM documents""")
def x10_x13_live_keys(spark, d):
    """X10, X13, D7."""
    i = F.col("doc_id")
    arxiv = F.when(i % 3 == 0, F.concat(F.lit("2101."), F.lpad(_s(i % 100000), 5, "0"), F.lit("v2")))
    doi = F.when(i % 3 == 1, F.concat(F.lit("10.48550/arXiv."), _s(i))).otherwise(F.concat(F.lit("10.1/X"), _s(i)))
    tier = _pick(i, "arxiv_html", "SEMANTIC_SCHOLAR", "openalex_pdf", "ar5iv")
    return table(spark, d, "documents").select("doc_id", ids.live_key(arxiv, doi).alias("live_key"), ids.tier_priority(tier).alias("priority"))


@query("""SELECT doc_id, 'p' || doc_id || '/1/' || t || '/ko/' || CASE WHEN t = 'summary' THEN 'full' ELSE 'abstract' END || '/' || CASE WHEN t = 'summary' THEN lang ELSE 'expert' END || '/' || (doc_id % 3) || '/' ||
CASE WHEN doc_id % 3 > 0 THEN 'u' || doc_id % 9 ELSE '-' END || '/m1/' || CASE WHEN t = 'summary' THEN 'p2' ELSE 'p2-f1' END || '/s1/4' AS cache_key FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'summary' ELSE 'translate' END AS t FROM documents)""")
def x33_cache_keys(spark, d):
    i = F.col("doc_id")
    request = {"paper_id": F.concat(F.lit("p"), _s(i)), "version": F.lit(1), "task": F.when(i % 2 == 0, "summary").otherwise("translate"), "lang": F.lit("ko"), "scope": F.lit("abstract"), "persona": F.col("lang")}
    key = ids.cache_key(request, i % 3, F.concat(F.lit("u"), _s(i % 9)), "m1", "p2", "f1", "s1", "parser@4")
    return table(spark, d, "documents").select("doc_id", key.alias("cache_key"))


@query("SELECT doc_id, source AS section, 2010 + doc_id % 15 AS year FROM documents WHERE doc_id % 4 = 0 AND 2010 + doc_id % 15 BETWEEN 2013 AND 2020")
def f10_f11_scope(spark, d):
    """F10, F11."""
    i = F.col("doc_id")
    chunks = table(spark, d, "documents").select("doc_id", F.col("source").alias("_source"), F.when(i % 4 == 0, "abstract").otherwise("body").alias("section"), (2010 + i % 15).alias("year"))
    return V.scoped(chunks, (2013, 2020), True).select("doc_id", F.col("_source").alias("section"), "year")


@query("""WITH a AS (SELECT source AS paper_id, doc_id % 3 AS version, doc_id AS asset_id, lang AS type, n_chars AS ordinal FROM documents),
n AS (SELECT * FROM a WHERE version = (SELECT max(version) FROM a b WHERE b.paper_id = a.paper_id))
SELECT paper_id, version, asset_id, type, ordinal, total FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS total, row_number() OVER (PARTITION BY paper_id ORDER BY type, ordinal, asset_id) AS k FROM n) WHERE k <= 60""")
def w1_asset_page(spark, d):
    a = table(spark, d, "documents").select(F.col("source").alias("paper_id"), (F.col("doc_id") % 3).alias("version"), F.col("doc_id").alias("asset_id"), F.col("lang").alias("type"), F.col("n_chars").alias("ordinal"))
    return V.listed_with_total(a, 60)


@query("SELECT * FROM (SELECT lang AS query_id, doc_id AS paper_id, n_chars % 100 AS ranking_score, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 100 DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 20")
def w3_ranked_candidates(spark, d):
    """W3, Q21."""
    return V.ranked_candidates(table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("paper_id"), (F.col("n_chars") % 100).alias("ranking_score")), 20)


@query("SELECT doc_id AS id, n_chars AS created_at, source FROM documents WHERE n_chars > 200 OR (n_chars = 200 AND doc_id > 5) ORDER BY created_at, id LIMIT 50")
def s6_messages_after(spark, d):
    """S6, S12."""
    return V.messages_after(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("created_at"), "source"), (200, 5), 50)


@query("SELECT event_id, ts, event_type AS state FROM events WHERE event_type IN ('view', 'click') AND ts < (SELECT max(ts) FROM events) ORDER BY ts, event_id LIMIT 200")
def s13_g16_oldest(spark, d):
    """S13, G16."""
    e = table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("state"))
    last = e.agg(F.max("ts").alias("m"))
    return V.oldest(e.crossJoin(F.broadcast(last)), ["view", "click"], F.col("m"), "ts", "event_id", 200).drop("m")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def u3_missing_ids(spark, d):
    return V.missing_ids(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("""SELECT doc_id, doc_id % 5 < 3 AS known, (CASE WHEN doc_id % 5 < 3 THEN 1 ELSE 0 END + 1) / 2.0::DOUBLE AS recall FROM documents""")
def u5_u6_sets(spark, d):
    """U5, U6."""
    i = F.col("doc_id") % 5
    want, have = F.array(i, F.lit(0).cast("long"), i), F.array(*[F.lit(k).cast("long") for k in (0, 1, 2)])
    return table(spark, d, "documents").select("doc_id", V.references_known(want, have).alias("known"), V.recall_of_sets(want, have).alias("recall"))


@query("""SELECT event_id, event_id % 4 = 1 OR event_id % 3 = 2 AS mismatch, CASE event_id % 4 WHEN 0 THEN 'lexical-only' WHEN 1 THEN 'rerank-off' ELSE 'normal' END AS mode,
CASE WHEN event_id % 5 = 0 THEN 'abstain' WHEN event_id % 3 = 0 THEN 'empty_page' WHEN event_id % 4 > 1 THEN 'page' ELSE 'degraded_page' END AS result,
CASE WHEN event_id % 3 > 0 THEN 'ok' WHEN event_id % 4 = 0 THEN 'llm_failure' WHEN event_id % 4 = 1 THEN 'cancelled' WHEN event_id % 5 = 0 THEN 'out_of_corpus' ELSE 'insufficient' END AS evidence FROM events""")
def q9_q17_states(spark, d):
    """Q9, Q10, Q11, Q17."""
    i = F.col("event_id")
    space = lambda model, dims: {"provider": F.lit("p"), "model": model, "dimensions": dims}
    clash = V.space_mismatch(space(F.lit("us.m1"), _pick(i, 64, 64, 128)), space(F.when(i % 4 == 1, "m2").otherwise("m1"), F.lit(64)))
    mode = V.degrade_mode(_pick(i, "LEXICAL_ONLY", "rerank-off", "odd", None))
    return table(spark, d, "events").select("event_id", clash.alias("mismatch"), mode.alias("mode"), V.result_status(i % 5 == 0, i % 3, mode).alias("result"), V.evidence_status(i % 3, _pick(i, "fatal_error", "cancelled", "done", "done"), i % 5).alias("evidence"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'forbidden_claim' WHEN k = 6 THEN 'unsupported_kind' WHEN k IN (0, 1, 2) AND doc_id % 3 = 0 THEN 'missing_source_refs' WHEN k IN (0, 1, 2, 3) AND doc_id % 3 = 2 THEN 'unknown_source_ref' WHEN k = 1 AND doc_id % 2 = 0 THEN 'missing_scope_note' END AS reason FROM (SELECT doc_id, doc_id % 7 AS k FROM documents)""")
def q18_artifact_gate(spark, d):
    i = F.col("doc_id")
    refs = F.when(i % 3 == 0, F.array().cast("array<string>")).when(i % 3 == 1, F.array(F.lit("r1"))).otherwise(F.array(F.lit("r1"), F.lit("r9")))
    kind = _pick(i, "similar_works", "gap_analysis", "novelty_candidates", "experiment_plan", "evidence", "external_findings", "poem")
    payload = F.when(i % 11 == 0, '{"items": [{"novelty_score" : 3}]}').otherwise('{"items": []}')
    reason = V.artifact_rejection(kind, payload, refs, F.array(F.lit("r1"), F.lit("r2")), F.lit("open_gap"), F.when(i % 2 == 0, " ").otherwise("noted"))
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"))


@query("""SELECT count(*) AS cases, avg((event_id % 6 = 0)::INT) AS abstain_rate, avg(CASE WHEN event_id % 4 > 0 THEN (event_id % 3) / 2.0 END) AS citation_reality, avg(CASE WHEN event_id % 5 > 0 THEN 0.25 END) AS synthesis_ratio,
avg(CASE WHEN event_id % 3 < 2 AND event_id % 6 <> 0 THEN (event_id % 7 > 0)::INT END) AS counter_probe_rate, avg(CASE WHEN event_id % 2 = 0 THEN (event_id % 10) / 10.0 END) AS recall_at_k FROM events""")
def a11_report_means(spark, d):
    """A11, Q20."""
    i = F.col("event_id")
    return V.report_means(table(spark, d, "events").select(
        (i % 6 == 0).alias("abstained"), F.when(i % 4 > 0, (i % 3) / 2.0).alias("citation_reality"), F.when(i % 5 > 0, F.lit(0.25)).alias("synthesis_ratio"), (i % 7).alias("counter_probes"),
        _pick(i, "claim", "comparison", "fact").alias("expected_kind"), F.when(i % 2 == 0, (i % 10) / 10.0).alias("recall_at_k")))


def _trace(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), i.alias("seq"), _pick(i, "search", "extract", "note").alias("tool"), F.when(i % 2 == 0, "counter").otherwise("for").alias("stance"), _pick(i, "ok", "empty", "error", "ok", "ok").alias("outcome"), F.col("props").alias("args"), (i % 4).cast("double").alias("cost"))


@query("SELECT user_id AS job_id, count(*) FILTER (WHERE event_id % 2 = 0 AND event_id % 3 < 2 AND event_id % 5 <> 2) AS probes, user_id % 2 = 0 AND count(*) FILTER (WHERE event_id % 2 = 0 AND event_id % 3 < 2 AND event_id % 5 <> 2) = 0 AS lacking FROM events GROUP BY 1")
def g2_g3_counter_probes(spark, d):
    """G2, G3."""
    found = V.counter_probes(_trace(spark, d), ["search", "extract"])
    return found.withColumn("lacking", V.lacks_counter_probe(F.when(F.col("job_id") % 2 == 0, "claim").otherwise("fact"), F.col("probes"), F.lit(True)))


@query("""WITH RECURSIVE c AS (SELECT user_id AS job_id, event_id AS seq, event_id % 3 = 0 AS search, (event_id % 4)::DOUBLE AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT job_id, 0 AS n, NULL::BIGINT AS seq, 0 AS calls, 0 AS searches, 0.0::DOUBLE AS spent, '' AS verdict FROM (SELECT DISTINCT job_id FROM c) UNION ALL
SELECT job_id, n, seq, calls + (v = 'ok')::INT, searches + (v = 'ok' AND search)::INT, spent + CASE WHEN v = 'ok' THEN cost ELSE 0 END, v FROM (
 SELECT c.*, calls, searches, spent, CASE WHEN calls >= 12 THEN 'tool_calls_exhausted' WHEN search AND searches >= 5 THEN 'tool_cap_exhausted' WHEN spent >= 9 THEN 'cost_exhausted' ELSE 'ok' END AS v FROM r JOIN c ON c.job_id = r.job_id AND c.n = r.n + 1))
SELECT job_id, seq, verdict FROM r WHERE n > 0""")
def g5_tool_budget(spark, d):
    """The SQL is the loop over a job's calls as a recursive query."""
    return V.tool_call_budget(_trace(spark, d), 12, {"search": 5}, 9.0)


@query("SELECT user_id AS job_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 6")
def g7_last_observations(spark, d):
    """G7."""
    return V.last_observations(_trace(spark, d).select("job_id", "seq"))


@query("SELECT user_id AS job_id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'looked' WHEN 1 THEN 'read' ELSE 'worked' END AS text, substr(props, 1, 200) AS query_summary FROM events WHERE event_id > 100 AND props IS NOT NULL")
def g14_t17_feed(spark, d):
    """G14, T17."""
    return V.activity_feed(V.trace_after(_trace(spark, d), 100), {"search": "looked", "extract": "read"}, "worked")


@query("""SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE (1990 + doc_id % 40)::VARCHAR END AS INT) AS year, 'S' || doc_id || CASE doc_id % 3 WHEN 1 THEN ' (a, b, c 외 1편에서 확인됨)' WHEN 2 THEN ' (a에서 확인됨). 다만 b는 다른 결과를 보고합니다' ELSE '' END || '.' AS answer FROM documents""")
def g9_g11_answers(spark, d):
    """G9, G11."""
    i = F.col("doc_id")
    some = lambda s: F.array(*map(F.lit, s)).cast("array<string>")
    answer = V.fallback_sentence(F.concat(F.lit("S"), _s(i), F.lit(". ")), F.when(i % 3 == 1, some("abcda")).when(i % 3 == 2, some("a")).otherwise(some("")), F.when(i % 3 == 2, some("b")).otherwise(some("")))
    return table(spark, d, "documents").select("doc_id", V.year_bound(F.when(i % 3 == 0, "x").otherwise(_s(1990 + i % 40))).alias("year"), answer.alias("answer"))


@query("""WITH c AS (SELECT conv_id AS turn_id, turn AS ord, unnest(['p' || turn % 3, 'p' || conv_id % 4]) AS p, unnest([0, 1]) AS pos FROM conversations), f AS (SELECT turn_id, p, min(struct_pack(o := ord, q := pos)) AS first_at FROM c GROUP BY 1, 2)
SELECT turn_id, list(p ORDER BY first_at) AS paper_ids FROM f GROUP BY 1""")
def g13_cited_papers(spark, d):
    p = lambda c: F.concat(F.lit("p"), _s(c))
    return V.cited_papers(table(spark, d, "conversations").select(F.col("conv_id").alias("turn_id"), F.col("turn").alias("ord"), F.array(p(F.col("turn") % 3), p(F.col("conv_id") % 4)).alias("refs")))


@query("""SELECT c_custkey AS owner_id, CASE WHEN c_custkey % 8 < 5 THEN 'delete' ELSE 'give_up' END AS action, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)) AS left_orders FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal <= 5000""")
def g18_g19_deletions(spark, d):
    """G18, G19."""
    k = F.col("c_custkey")
    accounts = table(spark, d, "customer").select(k.alias("owner_id"), F.when(k % 3 == 0, "pending_deletion").otherwise("active").alias("state"), F.col("c_acctbal").alias("due_at"), (k % 8).alias("attempts"))
    kept = V.purge_owner({"orders": table(spark, d, "orders").select(F.col("o_custkey").alias("owner_id"))}, accounts.where("state = 'pending_deletion'"))["orders"]
    total = kept.agg(F.count("*").alias("left_orders"))
    return V.due_deletions(accounts, F.lit(5000.0)).select("owner_id", "action").crossJoin(F.broadcast(total))


_STATES = "s AS (SELECT 'p' || doc_id AS paper_id, doc_id % 4 AS current_version, CASE WHEN doc_id % 3 = 0 THEN 'f' || doc_id END AS fingerprint, CASE WHEN doc_id % 5 = 0 THEN 'TOMBSTONED' ELSE 'INDEXED' END AS state FROM documents)"


@query(f"""WITH {_STATES}, x AS (SELECT paper_id, current_version, fingerprint, CASE WHEN current_version = 2 AND fingerprint IS NULL AND state = 'INDEXED' THEN 'EXCLUDED' ELSE state END AS state FROM s),
c AS (SELECT 'p' || (doc_id * 2) AS paper_id, 1 + doc_id % 2 AS v FROM documents)
SELECT coalesce(x.paper_id, c.paper_id) AS paper_id, CASE WHEN w THEN v ELSE current_version END AS current_version, CASE WHEN NOT w THEN fingerprint END AS fingerprint, CASE WHEN w THEN 'TOMBSTONED' ELSE state END AS state
FROM (SELECT x.*, c.paper_id AS cp, v, v IS NOT NULL AND (current_version IS NULL OR current_version <= v) AS w FROM x FULL JOIN c ON x.paper_id = c.paper_id) x LEFT JOIN (SELECT DISTINCT paper_id FROM c) c ON c.paper_id = x.cp""")
def d3_d4_transitions(spark, d):
    """D3, D4."""
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    p = lambda c: F.concat(F.lit("p"), _s(c)).alias("paper_id")
    states = docs.select(p(i), (i % 4).alias("current_version"), F.when(i % 3 == 0, F.concat(F.lit("f"), _s(i))).alias("fingerprint"), F.when(i % 5 == 0, "TOMBSTONED").otherwise("INDEXED").alias("state"))
    marked = V.excluded(states, docs.select(p(i), F.lit(2).cast("long").alias("version")))
    return V.tombstone_claims(marked, docs.select(p(i * 2), (1 + i % 2).alias("version")))


@query("SELECT doc_id, CASE WHEN n_chars - 100 < 500 THEN 'body_too_short' WHEN n_chars < 0.5 * (n_chars * (1 + doc_id % 3)) THEN 'truncated' ELSE 'ok' END AS quality FROM documents")
def d16_html_quality(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", V.html_quality(n - 100, n, n * (1 + F.col("doc_id") % 3)).alias("quality"))


@query("""WITH r AS (SELECT user_id, max(ts) AS r FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT event_id, e.user_id FROM events e LEFT JOIN r USING (user_id) WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND (r IS NULL OR ts > r)""")
def p3_p4_live_events(spark, d):
    """P3, P4."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("occurred_at"), "event_type")
    first = e.agg((F.min("occurred_at") + F.expr("INTERVAL 1 DAY")).alias("_cut"))
    resets = e.where("event_type = 'signup'").select("user_id", F.col("occurred_at").alias("reset_at"))
    return V.live_events(e.crossJoin(F.broadcast(first)), resets, F.col("_cut")).select("event_id", "user_id")


@query("SELECT user_id AS signal_id, CASE WHEN event_type = 'error' THEN 'block' ELSE 'abstain' END AS verdict, min(event_id) AS request_id, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2, 4")
def t11_hallucinations(spark, d):
    t = F.col("event_type")
    return V.hallucination_incidents(table(spark, d, "events").select(F.col("user_id").alias("signal_id"), F.when(t == "error", "block").when(t == "view", "abstain").otherwise("pass").alias("verdict"), F.col("event_id").alias("request_id")))


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id, event_id % 2 = 0 AND epoch(now)::BIGINT - floor(epoch(ts))::BIGINT >= CASE WHEN event_id % 3 = 0 THEN 1800 ELSE 600 END AS stale,
CASE WHEN event_id % 7 = 0 THEN 'unhealthy' WHEN floor(epoch(now))::BIGINT - floor(epoch(ts))::BIGINT > 86400 OR event_id % 4 = 3 THEN 'degraded' ELSE 'healthy' END AS health FROM events, n""")
def t18_t22_staleness(spark, d):
    """T18, T22."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    both, i = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))), F.col("event_id")
    stale = V.stale_turn(F.when(i % 2 == 0, "pending").otherwise("ok"), F.col("ts"), F.when(i % 3 != 0, F.col("ts")), F.col("now"), 600)
    return both.select("event_id", stale.alias("stale"), V.index_health(F.when(i % 7 != 0, F.col("ts")), i % 4, F.least(i % 4, F.lit(2)), F.col("now"), 86400).alias("health"))


_BOX = "b AS (SELECT doc_id, doc_id // 8 AS page_key, (doc_id * 7 % 20)::DOUBLE AS x0, (doc_id * 3 % 10)::DOUBLE AS y0, (doc_id * 7 % 20 + 6)::DOUBLE AS x1, (doc_id * 3 % 10 + 5)::DOUBLE AS y1 FROM documents)"


def _boxes(spark, d, key):
    i = F.col("doc_id")
    x, y = (i * 7 % 20).cast("double"), (i * 3 % 10).cast("double")
    return table(spark, d, "documents").select(i.alias(key), F.expr("doc_id div 8").alias("page_key"), x.alias("x0"), y.alias("y0"), (x + 6).alias("x1"), (y + 5).alias("y1"))


@query(f"""WITH {_BOX}, j AS (SELECT s.doc_id AS spec_id, r.doc_id AS region_id, (least(s.x1, r.x1 + 1) - greatest(s.x0, r.x0 + 1)) AS w, least(s.y1, r.y1) - greatest(s.y0, r.y0) AS h FROM b s JOIN b r USING (page_key) WHERE r.doc_id % 2 = 0)
SELECT spec_id, arg_max(region_id, struct_pack(a := w * h, r := -region_id)) AS region_id, max(w * h) AS area FROM j WHERE w > 0 AND h > 0 GROUP BY 1""")
def j10_region_match(spark, d):
    regions = _boxes(spark, d, "region_id").where("region_id % 2 = 0").withColumn("x0", F.col("x0") + 1).withColumn("x1", F.col("x1") + 1)
    return V.overlap_match(_boxes(spark, d, "spec_id"), regions)


@query(f"""WITH {_BOX}, c AS (SELECT doc_id AS region_id, page_key, x0 * 0 AS x0, x1 * 0 + 10 + doc_id % 2 AS x1, y0 * 0 AS y0, y1 * 0 + 10 AS y1 FROM b) SELECT region_id, page_key FROM c a WHERE EXISTS (SELECT 1 FROM c b WHERE a.page_key = b.page_key AND b.region_id < a.region_id AND least(a.x1, b.x1) * 10 >= 0.9 * (a.x1 * 10 + b.x1 * 10 - least(a.x1, b.x1) * 10))""")
def d25_duplicate_regions(spark, d):
    b = _boxes(spark, d, "region_id").select("region_id", "page_key", F.lit(0.0).alias("x0"), (10.0 + F.col("region_id") % 2).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"))
    return V.duplicate_regions(b).select("region_id", "page_key")


@query("""WITH r AS (SELECT doc_id // 5 AS float_id, doc_id AS ord, (doc_id // 3) % 2 AS page, (doc_id * 7 % 20)::DOUBLE AS x0, (doc_id * 7 % 20 + 6)::DOUBLE AS x1 FROM documents), f AS (SELECT float_id, arg_min(page, ord) AS page FROM r GROUP BY 1)
SELECT float_id, page, min(x0) AS x0, min(x0) AS y0, max(x1) AS x1, max(x1) AS y1 FROM r JOIN f USING (float_id, page) GROUP BY 1, 2""")
def h14_union_boxes(spark, d):
    i = F.col("doc_id")
    x = (i * 7 % 20).cast("double")
    return V.union_box(table(spark, d, "documents").select(F.expr("doc_id div 5").alias("float_id"), i.alias("ord"), F.expr("doc_id div 3 % 2").alias("page"), x.alias("x0"), x.alias("y0"), (x + 6).alias("x1"), (x + 6).alias("y1")))


@query("""WITH a AS (SELECT doc_id AS anchor_id, 'p' || doc_id % 9 AS paper_id, [['results'], ['additional', 'experimental', 'results'], ['the', 'experimental', 'results', 'show'], ['none']][(doc_id % 4) + 1] AS tokens FROM documents)
SELECT paper_id, anchor_id, CASE anchor_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS loc FROM a""")
def j13_anchor_locations(spark, d):
    i = F.col("doc_id")
    arr = lambda s: F.array(*map(F.lit, s.split()))
    tokens = F.when(i % 4 == 0, arr("results")).when(i % 4 == 1, arr("additional experimental results")).when(i % 4 == 2, arr("the experimental results show")).otherwise(arr("none"))
    anchors = table(spark, d, "documents").select(F.concat(F.lit("p"), _s(i % 9)).alias("paper_id"), i.alias("anchor_id"), tokens.alias("tokens"))
    keys = F.explode(F.array(F.struct(F.lit(1).alias("loc"), arr("experimental results").alias("key")), F.struct(F.lit(2).alias("loc"), arr("additional experimental results").alias("key")), F.struct(F.lit(3).alias("loc"), arr("results").alias("key"))))
    locations = spark.range(9).select(F.concat(F.lit("p"), _s(F.col("id"))).alias("paper_id"), keys.alias("k")).select("paper_id", "k.*")
    return V.anchor_location(anchors, locations)
