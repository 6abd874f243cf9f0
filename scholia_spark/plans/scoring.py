"""Queries of turn scores, incident routing, throttling, candidates and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.functions import ids, text
from scholia_spark.operators import scoring as S
from scholia_spark.plans.base import query, table


def _s(c):
    return c.cast("string")


def _pick(i, *values):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _numbered(df, n):
    """Rows 1 to n of each document as ``n``; none where n is 0."""
    return df.where(n > 0).withColumn("n", F.explode(F.sequence(F.lit(1), n.cast("int"))))


@query("""WITH d AS (SELECT doc_id AS i, ['claim', 'comparison', 'fact', 'out_of_scope'][doc_id % 4 + 1] AS kind, doc_id % 6 = 0 AS off, doc_id % 4 AS claims, doc_id % 3 AS rejected, doc_id % 8 <> 0 AS answered, doc_id % 9 = 0 AS fallback FROM documents),
t AS (SELECT i, count(*) FILTER (WHERE n % 2 = 1) AS searches, count(*) FILTER (WHERE n % 2 = 1 AND (i + n) % 5 = 0 AND (i + n) % 4 <> 0) AS probes FROM (SELECT i, unnest(range(1, i % 3 + 1)) AS n FROM d) GROUP BY 1),
r AS (SELECT i, count(*) AS refs, count(*) FILTER (WHERE (i + n) % 11 <> 0) AS made FROM (SELECT i, unnest(range(1, i % 4 + 1)) AS n FROM d) GROUP BY 1),
g AS (SELECT i, count(*) AS said, count(*) FILTER (WHERE n % 3 = 0) AS synth, bool_or(n > i % 4 OR i % 13 = 0) AS stray FROM (SELECT i, unnest(range(1, i % 5 + 1)) AS n FROM d) GROUP BY 1),
a AS (SELECT d.*, coalesce(searches, 0) AS searches, coalesce(probes, 0) AS probes, coalesce(refs, 0) AS refs, coalesce(made, 0) AS made, coalesce(said, 0) AS said, coalesce(synth, 0) AS synth, coalesce(stray, false) AS stray FROM d LEFT JOIN t USING (i) LEFT JOIN r USING (i) LEFT JOIN g USING (i))
SELECT i AS case_id, searches, probes AS counter_probes, CASE WHEN rejected + CASE WHEN off THEN 0 ELSE claims END > 0 THEN rejected / (rejected + CASE WHEN off THEN 0 ELSE claims END) END AS gate_rejection,
CASE WHEN NOT off AND refs > 0 THEN made / refs END AS citation_reality, CASE WHEN NOT off AND answered AND said > 0 THEN synth / said END AS synthesis_ratio,
CASE WHEN NOT off AND i % 7 > 0 THEN ((CASE WHEN i % 5 BETWEEN 1 AND least(claims, 2) THEN 1 ELSE 0 END)) / 2 END AS recall_at_k,
list_filter([CASE WHEN kind = 'out_of_scope' AND searches > 0 THEN 'searched_out_of_scope' END, CASE WHEN kind = 'out_of_scope' AND NOT off THEN 'answered_out_of_scope' END, CASE WHEN kind IN ('claim', 'comparison') AND NOT off AND probes = 0 THEN 'no_counter_probe' END,
 CASE WHEN NOT off AND made < refs THEN 'unreal_citation' END, CASE WHEN NOT off AND NOT answered THEN 'no_answer' END, CASE WHEN NOT off AND answered AND said = 0 THEN 'empty_answer' END, CASE WHEN NOT off AND answered AND NOT fallback AND stray THEN 'stray_reference' END], lambda x: x IS NOT NULL) AS violations FROM a""")
def q20_turn_scores(spark, d):
    """Q20."""
    i, docs = F.col("doc_id"), table(spark, d, "documents").select("doc_id")
    papers = F.when(i % 7 > 0, F.array(F.concat(F.lit("arxiv:P"), _s(i % 5), F.lit("v2")), F.lit("q")))
    case = i.alias("case_id")
    turns = docs.select(case, _pick(i, "claim", "comparison", "fact", "out_of_scope").alias("expected_kind"), papers.alias("expected_papers"), (i % 6 == 0).alias("abstained"), (i % 4).alias("claims"), (i % 3).alias("rejected"), (i % 8 != 0).alias("has_answer"), (i % 9 == 0).alias("fallback"))
    n = F.col("n")
    trace = _numbered(docs, i % 3).select(case, F.when(n % 2 == 1, "search").otherwise("note").alias("tool"), F.when((i + n) % 5 == 0, "counter").otherwise("for").alias("stance"), F.when((i + n) % 4 == 0, "error").otherwise("ok").alias("outcome"))
    refs = _numbered(docs, i % 4).select(case, n.alias("claim"), F.concat(F.lit("p"), _s(n)).alias("paper_id"), F.when((i + n) % 11 != 0, "r").alias("record_ref"))
    segments = _numbered(docs, i % 5).select(case, F.when(n % 3 == 0, "synthesis").otherwise("cited").alias("kind"), F.array(n.cast("bigint"), F.when(i % 13 == 0, 9).cast("bigint")).alias("refs"))
    return S.turn_scores(turns, trace, refs, segments, ["search"], top_k=2)


@query("""WITH s AS (SELECT event_id, event_id % 4 AS k, abs(value) AS amount, event_id % 120 AS uses, ['pass', 'abstain', 'block'][event_id % 3 + 1] AS verdict, event_id % 7 AS r FROM events)
SELECT event_id, 'cost_explosion' AS incident_class, CASE WHEN amount >= 80 THEN 'critical' ELSE 'warning' END AS severity FROM s WHERE k = 0 AND (amount >= 50 OR uses >= 100)
UNION ALL SELECT event_id, 'hallucination', CASE WHEN verdict = 'block' THEN 'critical' ELSE 'warning' END FROM s WHERE k = 1 AND verdict <> 'pass' UNION ALL SELECT event_id, 'partial_result', CASE WHEN r < 4 THEN 'critical' ELSE 'warning' END FROM s WHERE k = 2 AND r > 0""")
def t13_routed_incidents(spark, d):
    """T13."""
    i = F.col("event_id")
    reason = F.when(i % 7 == 0, F.lit(None)).when(i % 7 < 4, "retrieval failure was reported as success").otherwise("degraded execution was reported as success")
    return S.routed_incidents(table(spark, d, "events").select("event_id", _pick(i, "usage", "grounding", "partial_result", "other").alias("kind"), "ts", F.abs("value").alias("amount"), (i % 120).alias("uses"), F.lit(None).cast("bigint").alias("request_id"), _pick(i, "pass", "abstain", "block").alias("verdict"), reason.alias("reason")), 400.0)


@query("""WITH RECURSIVE q AS (SELECT user_id AS owner_id, event_id AS seq, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS due, floor(abs(value))::BIGINT % 8 AS amount, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT DISTINCT owner_id, 0::BIGINT AS seq, 0::BIGINT AS n, 0.0::DOUBLE AS granted, 5.0::DOUBLE AS held, 0.0::DOUBLE AS clock FROM q
UNION ALL SELECT owner_id, seq, n, CASE WHEN amount = 0 THEN due ELSE t + greatest(0, amount - have) / 0.0001::DOUBLE END, CASE WHEN amount = 0 THEN held ELSE greatest(0, have - amount) END, CASE WHEN amount = 0 THEN clock ELSE t + greatest(0, amount - have) / 0.0001::DOUBLE END
 FROM (SELECT q.*, s.held, s.clock, greatest(q.due, s.clock) AS t, least(5.0::DOUBLE, s.held + (greatest(q.due, s.clock) - s.clock) * 0.0001::DOUBLE) AS have FROM s JOIN q ON q.owner_id = s.owner_id AND q.n = s.n + 1))
SELECT owner_id, seq, round(granted, 2) AS granted_at FROM s WHERE n > 0""")
def t16_token_bucket(spark, d):
    """When each event of a user gets its tokens at the events' own times; two running windows against a loop over them."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1_704_067_200  # seconds of the year
    asked = table(spark, d, "events").select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("seq"), at.alias("at"), (F.floor(F.abs("value")).cast("long") % 8).alias("amount"))
    return S.token_bucket(asked, 0.0001, 5.0).select("owner_id", "seq", F.round("granted_at", 2).alias("granted_at"))


@query("SELECT 'p' || user_id AS paper_id, count(*) AS chunks FROM events WHERE 'p' || user_id > 'p2' GROUP BY 1 ORDER BY 1 LIMIT 20")
def a3_count_page(spark, d):
    """A3: a page."""
    return S.count_page(table(spark, d, "events").select(F.concat(F.lit("p"), _s(F.col("user_id"))).alias("paper_id")), 20, "p2")


@query("""WITH r AS (SELECT doc_id // 10 AS request_id, doc_id AS place, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 < 2 THEN 'arxiv:2101.0' || lpad((doc_id % 30)::VARCHAR, 4, '0') ELSE 'doi:10.1/x' || doc_id % 5 END AS key FROM documents)
SELECT request_id, key, min(place) AS place FROM r WHERE key IS NOT NULL GROUP BY 1, 2""")
def j11_live_candidates(spark, d):
    """J11."""
    i = F.col("doc_id")
    number = F.concat(F.lit("2101.0"), F.lpad(_s(i % 30), 4, "0"))
    arxiv = F.when(i % 11 == 0, "no id").when(i % 3 == 0, F.concat(number, F.when(i % 2 == 0, "v2").otherwise("")))
    doi = F.when(i % 3 == 1, F.concat(F.lit("10.48550/arXiv."), number)).when(i % 3 == 2, F.concat(F.lit("10.1/X"), _s(i % 5)))
    return S.live_candidates(table(spark, d, "documents").select(F.expr("doc_id div 10").alias("request_id"), i.alias("place"), arxiv.alias("arxiv_id"), doi.alias("doi"))).select("request_id", "key", "place")


@query("""SELECT job_id, paper_id, seq, row_number() OVER (PARTITION BY job_id ORDER BY seq)::INT AS candidates FROM (SELECT user_id AS job_id, 'p' || event_id % 20 AS paper_id, min(event_id) AS seq FROM events GROUP BY 1, 2)""")
def g8_registered_hits(spark, d):
    """G8."""
    hits = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.lit(0).alias("pos"), F.concat(F.lit("p"), _s(F.col("event_id") % 20)).alias("paper_id"))
    return S.registered_hits(hits).select("job_id", "paper_id", "seq", "candidates")


@query("""WITH w AS (SELECT c_custkey AS request_id, c_custkey AS owner_id, CASE WHEN c_custkey % 2 = 1 THEN c_custkey * 4 END AS item_id FROM customer)
SELECT request_id, o_orderkey AS item_id, o_totalprice AS price FROM w JOIN orders ON o_custkey = owner_id AND (item_id IS NULL OR item_id = o_orderkey)""")
def f13_owned(spark, d):
    """F13."""
    c = F.col("c_custkey")
    wanted = table(spark, d, "customer").select(c.alias("request_id"), c.alias("owner_id"), F.when(c % 2 == 1, c * 4).alias("item_id"))
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("price"))
    return S.owned(items, wanted).select("request_id", "item_id", "price")


_LINE = r"""list_filter(string_split_regex(lower(regexp_replace(regexp_replace({}, '(?i)^\s*(?:section\b|sec\.|§)\s*[:.\-]?\s*', ''), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda x: x <> '')"""


@query(rf"""WITH k AS (SELECT doc_id, lang, source, text, 'Sec. ' || string_split(text, chr(10))[1] AS line, ['가', '각', '갈', 'x'][doc_id % 4 + 1] AS term FROM documents),
t AS (SELECT *, {_LINE.format('line')} AS tokens, {_LINE.format('source')} AS needle FROM k)
SELECT doc_id, lower(source) || '/' || doc_id AS id_key, '10.1/' || lower(source) AS doi, sha256(concat_ws('|', lang, source, text)) AS dedupe_key, tokens, contains(' ' || array_to_string(tokens, ' ') || ' ', ' ' || array_to_string(needle, ' ') || ' ') AS holds,
CASE WHEN unicode(term) BETWEEN 44032 AND 55203 THEN (unicode(term) - 44032) % 28 END AS final,
CASE WHEN doc_id % 2 = 0 THEN ['b', lang || source] WHEN lang = 'b' THEN ['b'] ELSE [lang, 'b'] END AS keys FROM t""")
def x11_scalar_keys(spark, d):
    """X11, X14, X22, X23, X24, X29, U4."""
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    named = F.concat(F.lit(" arXiv:"), F.upper("source"), F.lit("/"), _s(i), F.when(i % 2 == 0, "v3").otherwise(""))
    doi = F.concat(_pick(i, "HTTPS://doi.org/", "http://dx.doi.org/", "doi:", ""), F.lit("10.1/"), F.upper("source"))
    tokens = text.label_tokens(F.concat(F.lit("Sec. "), F.element_at(F.split("text", "\n"), 1)))
    nothing = F.lit(None).cast("string")
    keys = S.ordered_keys(F.when(i % 2 == 1, F.col("lang")), F.lit(""), F.lit("b"), F.when(i % 2 == 0, F.concat("lang", "source")), nothing, F.lit("b"))
    return docs.select(
        "doc_id", ids.id_key(named).alias("id_key"), ids.bare_doi(doi).alias("doi"), ids.dedupe_key(F.col("lang"), F.col("source"), F.col("text")).alias("dedupe_key"), tokens.alias("tokens"),
        text.contiguous(text.label_tokens(F.col("source")), tokens).alias("holds"), text.final_jamo(_pick(i, "가", "각", "갈", "x")).alias("final"), keys.alias("keys"),
    )
