"""Activity queries over events, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.operators import activity as A
from scholia_spark.plans.base import query, table

_EV = """e AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'opened' WHEN 'purchase' THEN 'added' WHEN 'error' THEN 'removed' WHEN 'click' THEN 'search' ELSE 'summary' END AS event_type,
 'c' || (event_id % 6) AS category, 'p' || (event_id % 9) AS paper_id, value FROM events),
cw AS (SELECT user_id, category, sum(CASE event_type WHEN 'opened' THEN 1.0 WHEN 'added' THEN 3.0 WHEN 'summary' THEN 2.0 WHEN 'search' THEN 0.5 ELSE 0.0 END)::DOUBLE AS total FROM e GROUP BY ALL HAVING total > 0)"""


def _events(spark, d):
    kind = F.when(F.col("event_type") == "view", "opened").when(F.col("event_type") == "purchase", "added").when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "click", "search").otherwise("summary")
    tag = lambda c, n: F.concat(F.lit(c), (F.col("event_id") % n).cast("string"))
    return table(spark, d, "events").select("event_id", "ts", "user_id", kind.alias("event_type"), tag("c", 6).alias("category"), tag("p", 9).alias("paper_id"), "value")


@query(f"WITH {_EV} SELECT user_id, category, total FROM cw")
def p1_category_weights(spark, d):
    """P1, A6."""
    return A.category_weights(_events(spark, d))


@query(f"""WITH {_EV}, x AS (SELECT *, max(CASE WHEN event_type = 'removed' THEN 1 END) OVER (PARTITION BY user_id, paper_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone FROM e)
SELECT user_id, paper_id, sum(CASE event_type WHEN 'opened' THEN 1.0 WHEN 'added' THEN 3.0 ELSE 0.0 END)::DOUBLE AS total FROM x WHERE gone IS NULL GROUP BY ALL HAVING total > 0""")
def p1_paper_signals(spark, d):
    return A.paper_signals(_events(spark, d))


_CHOICES = """x AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'summary' WHEN 'error' THEN 'glossary' ELSE 'opened' END AS kind,
 ['k' || (event_id % 5), 'k' || (event_id % 3), NULL] AS keywords, CASE WHEN event_id % 3 > 0 THEN 'p' || (event_id % 4) END AS persona, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'abstract' ELSE 'full' END AS scope, 'g' || (event_id % 7) AS glossary FROM events)"""


def _choices(spark, d):
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "summary").when(F.col("event_type") == "error", "glossary").otherwise("opened")
    tag = lambda c, n: F.concat(F.lit(c), (i % n).cast("string"))
    scope = F.when(i % 4 == 0, "").when(i % 4 == 1, "abstract").otherwise("full")
    return table(spark, d, "events").select("event_id", "ts", "user_id", kind.alias("event_type"), F.array(tag("k", 5), tag("k", 3), F.lit(None)).alias("keywords"), F.when(i % 3 > 0, tag("p", 4)).alias("persona"), scope.alias("scope"), tag("g", 7).alias("glossary"))


@query(f"WITH {_CHOICES} SELECT user_id, keyword, count(*) * 0.25::DOUBLE AS total FROM (SELECT user_id, unnest(keywords) AS keyword FROM x WHERE kind = 'search') WHERE keyword IS NOT NULL GROUP BY ALL")
def p1_keyword_weights(spark, d):
    return A.keyword_weights(_choices(spark, d))


@query(f"""WITH {_CHOICES} SELECT user_id, arg_max(persona, struct_pack(t := ts, e := event_id)) FILTER (WHERE kind = 'summary' AND persona <> '') AS persona,
 arg_max(scope, struct_pack(t := ts, e := event_id)) FILTER (WHERE kind = 'summary' AND scope <> '') AS scope, arg_max(glossary, struct_pack(t := ts, e := event_id)) FILTER (WHERE kind = 'glossary') AS glossary FROM x GROUP BY 1""")
def p1_last_choices(spark, d):
    return A.last_choices(_choices(spark, d))


@query(f"""WITH {_EV}, b AS (SELECT user_id, category, least(1.0, total / max(total) OVER (PARTITION BY user_id)) AS w FROM cw),
r AS (SELECT user_id, category, 0.1::DOUBLE * round_even(w, 4) AS b FROM b), s AS (SELECT *, sum(abs(b)) OVER (PARTITION BY user_id) AS t FROM r)
SELECT user_id, category, round(CASE WHEN t > 0.2::DOUBLE THEN b * 0.2::DOUBLE / t ELSE b END, 9) AS boost FROM s""")
def n6_search_boosts(spark, d):
    """N5, N6, P5."""
    return A.search_boosts(A.bounded(A.category_weights(_events(spark, d)), "user_id", "category", "total"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def w4_retention(spark, d):
    """W4, D27."""
    return A.keep_newest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id")


@query("""WITH f AS (SELECT * FROM (SELECT *, event_id % 13 AS k, row_number() OVER (PARTITION BY user_id, event_id % 13 ORDER BY ts, event_id) AS f FROM events) WHERE f = 1)
SELECT user_id, k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM f) WHERE q <= 3""")
def d28_quota(spark, d):
    """D28, P2, A2."""
    e = table(spark, d, "events").withColumn("k", F.col("event_id") % 13)
    return A.quota_admit(e, "user_id", "k", [F.col("ts"), F.col("event_id")], 3).select("user_id", "k", "event_id")


@query(f"""WITH {_EV}, l AS (SELECT user_id, paper_id, max(struct_pack(ts := ts, event_id := event_id)) AS last FROM e WHERE event_type = 'opened' GROUP BY ALL)
SELECT user_id, paper_id, last.ts AS ts, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, paper_id)::INT AS place FROM l) WHERE place <= 50""")
def w12_recent_papers(spark, d):
    return A.recent_papers(_events(spark, d))


@query("""SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20)""")
def s3_keyset_second_page(spark, d):
    """The page behind the cursor of the first."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    cursor = A.keyset_page(o, "o_orderdate", "o_orderkey", 20)[1]
    return A.keyset_page(o, "o_orderdate", "o_orderkey", 20, cursor)[0] if cursor else o.limit(0)


@query("""WITH u AS (SELECT (user_id % 50)::BIGINT AS owner_id, event_id, ts, abs(value) AS amount FROM events),
r AS (SELECT owner_id, event_id, round(sum(amount) OVER (PARTITION BY owner_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS spend FROM u), q AS (SELECT *, round(spend / 1600.0, 6) AS ratio FROM r)
SELECT owner_id, event_id, round(spend, 2) AS spend, CASE WHEN ratio >= 1 THEN 'open' WHEN ratio >= 0.8 THEN 'half_open' ELSE 'closed' END AS circuit,
 CASE WHEN ratio >= 0.95 THEN 'lexical_only' WHEN ratio >= 0.8 THEN 'rerank_off' ELSE 'normal' END AS mode FROM q""")
def w5_running_spend(spark, d):
    """W5, T14."""
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("owner_id"), "event_id", "ts", F.abs("value").alias("amount"))
    return A.running_spend(e, 1600.0).withColumn("spend", F.round("spend", 2)).drop("ratio")


@query("""WITH u AS (SELECT event_id, abs(value) AS amount, event_id % 120 AS uses FROM events)
SELECT * FROM (SELECT event_id, CASE WHEN amount / 400 >= 1 OR amount >= 80 THEN 'critical' WHEN amount / 400 >= 0.8 OR amount >= 50 OR uses >= 100 THEN 'warning' END AS severity FROM u) WHERE severity IS NOT NULL""")
def t9_cost_incidents(spark, d):
    """T8, T9, T10."""
    e = table(spark, d, "events").select("event_id", "ts", F.abs("value").alias("amount"), (F.col("event_id") % 120).alias("uses"))
    return A.cost_incidents(e.union(e), 400.0)


@query("""WITH l AS (SELECT user_id % 20 AS worker, event_id AS seq, CASE WHEN event_id % 3 <> 0 OR event_id % 500 < 200 THEN 1 ELSE 0 END AS failed FROM events)
SELECT worker, seq, (count(*) OVER a = 50 AND avg(failed) OVER a > 0.6) OR (count(*) OVER b = 12 AND min(failed) OVER b = 1) AS collapsed FROM l
WINDOW a AS (PARTITION BY worker ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), b AS (PARTITION BY worker ORDER BY seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def w6_collapse(spark, d):
    failed = F.when((F.col("event_id") % 3 != 0) | (F.col("event_id") % 500 < 200), 1).otherwise(0)
    return A.collapsed(table(spark, d, "events").select((F.col("user_id") % 20).alias("worker"), F.col("event_id").alias("seq"), failed.alias("failed")))


_TURNS = "t AS (SELECT conv_id AS session_id, turn AS turn_id, length(text) AS cost FROM conversations)"


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), F.length("text").cast("long").alias("cost"))


@query(f"WITH {_TURNS} SELECT session_id, turn_id, cost, running FROM (SELECT *, sum(cost) OVER w::BIGINT AS running, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn_id DESC ROWS UNBOUNDED PRECEDING)) WHERE running <= 2000 OR n = 1".replace("sum(cost) OVER w::BIGINT", "(sum(cost) OVER w)::BIGINT"))
def w7_token_budget(spark, d):
    return A.token_budget(_turns(spark, d), 2000)


@query(f"WITH {_TURNS}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) AS n FROM t) WHERE n > 2) SELECT session_id, turn_id, cost, row_number() OVER (PARTITION BY session_id ORDER BY turn_id)::INT AS place FROM o")
def w8_beyond_newest(spark, d):
    return A.beyond_newest(_turns(spark, d), 2)


@query("""WITH i AS (SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '1990-01-01' AND TIMESTAMP '2100-01-01'), s AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS large FROM i GROUP BY 1),
r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place FROM i)
SELECT s.event_type, n, large, round(large / n, 6) AS rate, r.value AS p95 FROM s JOIN r ON s.event_type = r.event_type AND r.place = least(floor(n * 0.95::DOUBLE)::BIGINT, n - 1)""")
def a8_dashboard(spark, d):
    return A.dashboard(table(spark, d, "events"), "1990-01-01", "2100-01-01")


@query("""WITH m AS (SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '1990-01-01' AND TIMESTAMP '2100-01-01'), l AS (SELECT abs(value) AS v, row_number() OVER (ORDER BY abs(value)) - 1 AS p, count(*) OVER () AS n FROM m WHERE event_id % 3 = 0),
s AS (SELECT (count(*) FILTER (WHERE event_id % 3 = 1))::DOUBLE AS throughput, count(*) FILTER (WHERE event_id % 3 = 0 AND user_id % 11 = 0) AS errors, count(*) FILTER (WHERE event_id % 3 = 2 AND event_type = 'view') AS grounding_pass,
 count(*) FILTER (WHERE event_id % 3 = 2 AND event_type = 'error') AS grounding_block, count(*) FILTER (WHERE event_id % 3 = 2 AND event_type = 'click') AS grounding_abstain, count(*) FILTER (WHERE event_id % 3 = 2 AND event_type NOT IN ('view', 'error', 'click')) AS grounding_unknown,
 count(*) FILTER (WHERE event_type = 'error') AS incidents FROM m)
SELECT s.*, (SELECT round(max(v), 6) FROM l WHERE p = least(floor(n * 0.95::DOUBLE)::BIGINT, n - 1)) AS p95, round(errors / throughput, 6) AS error_rate FROM s""")
def a8_request_metrics(spark, d):
    """Request metrics, verdict counts and incidents of one window."""
    e, i = table(spark, d, "events"), F.col("event_id")
    name = F.when(i % 3 == 0, "latency").when(i % 3 == 1, "throughput").otherwise("grounding")
    verdict = F.when(F.col("event_type") == "view", "pass").when(F.col("event_type") == "error", "block").when(F.col("event_type") == "click", "abstain")
    metrics = e.select("ts", name.alias("name"), F.abs("value").alias("value"), F.when(F.col("user_id") % 11 == 0, "503").otherwise("200").alias("status"), verdict.alias("verdict"))
    return A.request_metrics(metrics, e.where("event_type = 'error'").select("ts"), F.lit("1990-01-01").cast("timestamp_ntz"), F.lit("2100-01-01").cast("timestamp_ntz"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ts, o_orderkey::VARCHAR AS id FROM orders")
def s4_cursors(spark, d):
    """Cursors coded and read back."""
    o = table(spark, d, "orders").select("o_orderkey", A.cursor_parts(A.cursor_code(F.col("o_orderdate"), F.col("o_orderkey"))).alias("c"))
    return o.select("o_orderkey", F.substring("c.ts", 1, 10).alias("ts"), "c.id")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate FROM orders), k AS (SELECT o_orderkey, o_orderdate FROM o ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 9)
SELECT o.o_orderkey, o.o_orderdate FROM o, k WHERE (o.o_orderdate, o.o_orderkey) < (k.o_orderdate, k.o_orderkey) ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 15""")
def g15_page_after(spark, d):
    """The page behind a known row."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    at = A.offset_page(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], 1, 9).head()
    return A.page_after(o, "o_orderdate", "o_orderkey", 15, at["o_orderkey"]) if at else o.limit(0)


@query("SELECT c AS event_type, (SELECT count(*) FROM events WHERE event_type = c) AS n FROM (VALUES ('view'), ('error'), ('never')) v(c)")
def a9_counts_by_class(spark, d):
    """A9, T21."""
    return A.counts_by_class(table(spark, d, "events"), ["view", "error", "never"], "event_type")


@query("SELECT event_type AS source, max(ts) AS ts FROM events GROUP BY 1")
def t3_watermarks(spark, d):
    """T3; the streaming form is in streaming.jobs."""
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), "ts")
    return A.advance_watermarks(e.groupBy("source").agg(F.min("ts").alias("ts")), e)


def _calls(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 30).alias("key"), F.col("event_id").alias("call_id"), (F.col("event_id") * 7 / 1.0).alias("t"))


_KEYED = "WITH RECURSIVE c AS (SELECT user_id % 30 AS key, event_id AS call_id, event_id * 7 / 1.0 AS t, row_number() OVER (PARTITION BY user_id % 30 ORDER BY event_id) AS n FROM events)"


@query(f"""{_KEYED}, r AS (SELECT *, true AS allowed, [t] AS passed FROM c WHERE n = 1 UNION ALL
SELECT key, call_id, t, n, len(kept) < 5, CASE WHEN len(kept) < 5 THEN list_append(kept, t) ELSE kept END FROM (SELECT c.*, list_filter(passed, lambda x: c.t - x < 3000) AS kept FROM r JOIN c ON c.key = r.key AND c.n = r.n + 1))
SELECT key, call_id, allowed FROM r""")
def t15_sliding_limit(spark, d):
    """The SQL is the loop over calls as a recursive query."""
    return A.sliding_limit(_calls(spark, d), 5, 3000.0)


@query(f"""{_KEYED}, r AS (SELECT *, t + 3000 AS reset, 1 AS used FROM c WHERE n = 1 UNION ALL
SELECT c.*, CASE WHEN c.t >= reset THEN c.t + 3000 ELSE reset END, CASE WHEN c.t >= reset THEN 1 ELSE used + 1 END FROM r JOIN c ON c.key = r.key AND c.n = r.n + 1)
SELECT key, call_id, used <= 5 AS allowed FROM r""")
def t23_fixed_limit(spark, d):
    """The SQL is the loop over calls as a recursive query."""
    return A.fixed_limit(_calls(spark, d), 5, 3000.0)


_CITES = """c AS (SELECT 'd' || (doc_id % 20) AS root, CASE WHEN doc_id % 23 <> 0 THEN 'd' || (doc_id * 7 + 3) % 60 END AS node_id, (doc_id * 13 % 50)::BIGINT AS citations, (2000 + doc_id % 25)::INT AS year,
 CASE WHEN doc_id % 29 <> 0 THEN 't' || doc_id % 61 END AS title FROM documents)"""


def _cites(spark, d):
    i = F.col("doc_id")
    s = lambda c, x: F.concat(F.lit(c), x.cast("string"))
    return table(spark, d, "documents").select(
        s("d", i % 20).alias("root"), F.when(i % 23 != 0, s("d", (i * 7 + 3) % 60)).alias("node_id"), (i * 13 % 50).alias("citations"), (2000 + i % 25).cast("int").alias("year"), F.when(i % 29 != 0, s("t", i % 61)).alias("title")
    )


@query(f"""WITH {_CITES}, r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY CASE WHEN coalesce(citations, 0) = 0 THEN -1 ELSE citations END DESC, year DESC, title, node_id)::INT AS place FROM c WHERE node_id IS NOT NULL AND title IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY root, node_id ORDER BY place) > 1 OR node_id = root AS already_shown FROM r) SELECT root, place, node_id, already_shown FROM a WHERE place <= 30""")
def q22_citation_tree(spark, d):
    """Q22, Q23, S7."""
    return A.citation_tree(_cites(spark, d))


@query(f"""WITH {_CITES}, t AS (SELECT root, count(*) AS total, count(*) FILTER (WHERE node_id IS NULL OR title IS NULL) AS unresolved FROM c GROUP BY 1), s AS (SELECT *, least(30, total - unresolved) AS shown FROM t)
SELECT root, shown, unresolved, greatest(0, total - shown - unresolved) AS remaining, CASE WHEN unresolved > 0 THEN 'partial' ELSE 'complete' END AS status, round(unresolved / greatest(1, shown + unresolved), 6) AS ratio FROM s""")
def q22_citation_totals(spark, d):
    """Q22, A21."""
    return A.citation_totals(_cites(spark, d))


@query("""WITH x AS (SELECT DISTINCT user_id AS key, event_id % 12 + 1 AS n FROM events), r AS (SELECT key, n, row_number() OVER (PARTITION BY key ORDER BY n) AS p FROM x)
SELECT key, coalesce(max(CASE WHEN n = p THEN n END), 0) AS prefix FROM r GROUP BY 1""")
def h22_contiguous_prefix(spark, d):
    return A.contiguous_prefix(table(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 12 + 1).alias("n")))


@query("""SELECT o_orderkey, c_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND o_orderkey > 100""")
def j1_owner_trace(spark, d):
    """Trace rows of one owner group behind a sequence number."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.where("o_orderkey > 100").join(c.where("c_nationkey = 7"), o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_custkey", "o_totalprice")


@query("SELECT vec_id, doc_id IS NOT NULL AS in_corpus, coalesce(source, 'none') AS category FROM embeddings LEFT JOIN documents ON doc_id = vec_id * 3")
def j3_j5_enrich(spark, d):
    """Left join with a flag and a default."""
    e, docs = table(spark, d, "embeddings").select("vec_id"), table(spark, d, "documents").select("doc_id", "source")
    return e.join(docs, F.col("doc_id") == F.col("vec_id") * 3, "left").select("vec_id", F.col("doc_id").isNotNull().alias("in_corpus"), F.coalesce("source", F.lit("none")).alias("category"))


@query("""SELECT count(*) AS scanned, count(*) FILTER (WHERE e.vec_id % 4 > 0 AND d.source IS NOT NULL) AS updated, count(*) FILTER (WHERE e.vec_id % 4 > 0 AND d.source IS NULL) AS unresolved FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id * 3""")
def j6_backfill_counts(spark, d):
    """Rows without a category get that of their paper, and what happened is counted."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("paper_id"), F.when(F.col("vec_id") % 4 == 0, "known").alias("category"))
    resolver = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("found"))
    return A.backfill_counts(A.backfill(e, resolver))
