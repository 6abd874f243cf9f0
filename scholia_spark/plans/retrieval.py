"""Retrieval queries: benchmark items are the queries, documents the papers (one chunk each)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.operators import retrieval as R
from scholia_spark.plans.base import query, table


def _chunks(spark, d):
    docs = table(spark, d, "documents")
    tokens = F.array_remove(F.split(F.lower("text"), r"\s+"), "")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("paper_id"), "text", tokens.alias("tokens"))


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_remove(F.split(F.lower("text"), r"\s+"), "").alias("terms"))


_TOKENS = """c AS (SELECT doc_id AS chunk_id, doc_id AS paper_id, text, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS tokens FROM documents),
q AS (SELECT item_id AS query_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS terms FROM benchmark),
qt AS (SELECT query_id, unnest(list_distinct(terms)) AS term FROM q), """
_LEX = _TOKENS + """p AS (SELECT chunk_id, paper_id, unnest(list_distinct(tokens)) AS term FROM c),
h AS (SELECT query_id, paper_id, chunk_id, count(*)::DOUBLE AS score FROM p JOIN qt USING (term) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM h) WHERE rank <= 150)"""
_BM25 = _TOKENS + """t AS (SELECT chunk_id, paper_id, len(tokens) AS n, unnest(tokens) AS term FROM c),
tf AS (SELECT term, chunk_id, paper_id, n, count(*) AS tf FROM t WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT count(*) AS docs, avg(len(tokens)) AS mean FROM c WHERE len(tokens) > 0),
h AS (SELECT query_id, paper_id, chunk_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) ORDER BY term) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), s GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM h) WHERE rank <= 150)"""
_KNN = """qv AS (SELECT vec_id // 50 AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
kh AS (SELECT query_id, vec_id AS paper_id, vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, qv),
kn AS (SELECT query_id, paper_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM kh) WHERE rank <= 150)"""
_FUSED = """parts AS (SELECT query_id, paper_id, 0 AS list, 1.0 / (60 + rank) AS part FROM lex UNION ALL SELECT query_id, paper_id, 1, 1.0 / (60 + rank) FROM kn),
f AS (SELECT query_id, paper_id, sum(part ORDER BY list) AS score, arg_min(list, struct_pack(p := -part, l := list)) AS from_list FROM parts GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id)::INT AS rank FROM f)"""


@query(f"WITH {_LEX} SELECT query_id, paper_id, chunk_id, score, rank FROM lex")
def q2b_term_overlap(spark, d):
    return R.term_overlap(_queries(spark, d), _chunks(spark, d))


def _shown(df, places, column="score"):
    """Rounded for comparison, after everything is ranked."""
    return df.withColumn(column, F.round(column, places))


@query(f"WITH {_BM25} SELECT query_id, paper_id, chunk_id, round(score, 6) AS score, rank FROM bm")
def q2_bm25(spark, d):
    return _shown(R.bm25(_queries(spark, d), _chunks(spark, d)), 6)


def _field_sql(name: str, tokens: str) -> str:
    return f"""{name}_t AS (SELECT chunk_id, paper_id, len({tokens}) AS n, unnest({tokens}) AS term FROM c),
{name}_tf AS (SELECT term, chunk_id, paper_id, n, count(*) AS tf FROM {name}_t WHERE term IN (SELECT term FROM qt) GROUP BY ALL), {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1),
{name}_s AS (SELECT count(*) AS docs, avg(len({tokens})) AS mean FROM c WHERE len({tokens}) > 0),
{name}_h AS (SELECT query_id, paper_id, chunk_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) ORDER BY term) AS score FROM {name}_tf JOIN {name}_df USING (term) JOIN qt USING (term), {name}_s GROUP BY ALL)"""


_LINE = "list_filter(string_split_regex(lower(string_split(text, chr(10))[1]), '\\s+'), lambda x: x <> '')"


@query(f"""WITH {_TOKENS}{_field_sql('a', _LINE)}, {_field_sql('b', 'tokens')}, m AS (SELECT query_id, paper_id, chunk_id, max(score) AS score FROM (SELECT * FROM a_h UNION ALL SELECT * FROM b_h) GROUP BY ALL)
SELECT query_id, paper_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM m) WHERE rank <= 150""")
def q2_bm25_fields(spark, d):
    """Q2 over two fields: a document's first line, and its text."""
    line = F.array_remove(F.split(F.lower(F.element_at(F.split("text", "\n"), 1)), r"\s+"), "")
    return _shown(R.bm25(_queries(spark, d), _chunks(spark, d).withColumn("line", line), fields=("line", "tokens")), 6)


def _words(text):
    """Runs of letters and digits, in lower case: what an index keeps of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_PHRASES = f"""c AS (SELECT doc_id, source, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS body FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark)"""


@query(f"""WITH {_PHRASES}, q AS (SELECT item_id * 4 AS query_id, w AS p FROM i UNION ALL SELECT item_id * 4 + 1, w[3:4] FROM i UNION ALL SELECT item_id * 4 + 2, w[2:2] FROM i UNION ALL SELECT item_id * 4 + 3, w[3:4] FROM i),
h AS (SELECT query_id, doc_id AS paper_id FROM c, q WHERE len(p) > 0 AND contains(body, ' ' || array_to_string(p, ' ') || ' ') AND (query_id % 4 <> 3 OR 2010 + doc_id % 15 BETWEEN 2013 AND 2020))
SELECT query_id, paper_id, paper_id AS chunk_id, 1.0::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY paper_id)::INT AS rank FROM h) WHERE rank <= 150""")
def q3_phrase(spark, d):
    """Q3: whole items, two words of each, one word, and two words within years, as runs of words."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("i"), _words("text").alias("w"))
    year = F.lit(None).cast("int")
    asked = F.array(*[F.struct(F.lit(n).alias("n"), p.alias("phrase"), y[0].alias("since"), y[1].alias("until")) for n, p, y in (
        (0, F.col("w"), (year, year)), (1, F.slice("w", 3, 2), (year, year)), (2, F.slice("w", 2, 1), (year, year)), (3, F.slice("w", 3, 2), (F.lit(2013), F.lit(2020))))])
    queries = items.select("i", F.explode(asked).alias("q")).select((F.col("i") * 4 + F.col("q.n")).alias("query_id"), "q.phrase", "q.since", "q.until")
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("paper_id"), (2010 + F.col("doc_id") % 15).alias("year"), _words("text").alias("tokens"))
    return R.phrase_match(queries, chunks)


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("paper_id"), F.col("embedding").alias("vector"))
    return e.where("vec_id % 50 = 0").select(F.expr("vec_id div 50").alias("query_id"), F.col("embedding").alias("vector")), chunks


def _knn(spark, d):
    q, c = _vectors(spark, d)
    return R.rank_by(R.knn(q, c), ["query_id"], [F.desc("score"), F.col("chunk_id")])


@query(f"WITH {_KNN} SELECT query_id, paper_id, chunk_id, round(score, 6) AS score, rank FROM kn")
def q1_knn(spark, d):
    return _shown(_knn(spark, d), 6)


@query(f"WITH {_LEX}, {_KNN}, {_FUSED} SELECT query_id, paper_id, round(score, 9) AS score, from_list, rank FROM fr")
def q4_rank_fusion(spark, d):
    return _shown(R.fuse(R.term_overlap(_queries(spark, d), _chunks(spark, d)), _knn(spark, d)), 9)


@query(f"WITH {_LEX}, {_KNN}, {_FUSED} SELECT query_id, paper_id, round(score, 9) AS score, from_list, rank FROM fr WHERE rank <= 20 AND query_id NOT IN (SELECT query_id FROM kn GROUP BY 1 HAVING max(score) < 0.2)")
def q5_hybrid_search(spark, d):
    """Both legs, fusion, the no-match floor on the raw vector score, top 20."""
    knn = _knn(spark, d)
    fused = R.fuse(R.term_overlap(_queries(spark, d), _chunks(spark, d)), knn)
    return _shown(R.no_match_floor(fused.where(F.col("rank") <= R.TOP_N), knn, 0.2), 9)


@query(f"""WITH {_LEX}, r AS (SELECT query_id, paper_id, rank, (paper_id * 37 % 101)::DOUBLE AS rerank FROM lex),
m AS (SELECT *, min(CASE WHEN rank <= 80 THEN rerank END) OVER w AS floor, sum(CASE WHEN rank <= 80 THEN 0 ELSE 1 END) OVER w AS tail FROM r WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT query_id, paper_id, rank, CASE WHEN rank <= 80 THEN rerank ELSE floor - 1e-3::DOUBLE / tail * (rank - 80) END AS ranking_score FROM m)
SELECT query_id, paper_id, rank, round(ranking_score, 9) AS ranking_score, row_number() OVER (PARTITION BY query_id ORDER BY ranking_score DESC, paper_id)::INT AS final_rank FROM s""")
def q7_rerank_fold(spark, d):
    """Q6, Q7."""
    lex = R.term_overlap(_queries(spark, d), _chunks(spark, d)).select("query_id", "paper_id", "rank", (F.col("paper_id") * 37 % 101).cast("double").alias("rerank"))
    return _shown(R.fold_rerank(lex, 80), 9, "ranking_score").select("query_id", "paper_id", "rank", "ranking_score", "final_rank")


@query(f"""WITH {_LEX}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM lex),
b AS (SELECT query_id, paper_id, rank, score, CASE WHEN rank <= least(n, greatest(2, ceil(n * 0.3::DOUBLE))) THEN 0 ELSE 1 END AS band,
 CASE WHEN paper_id % 4 = 0 THEN 0.1 WHEN paper_id % 4 = 1 THEN -0.05 ELSE 0.0 END AS v FROM n),
x AS (SELECT *, CASE WHEN band = 0 THEN score + abs(score) * v ELSE score END AS boosted, bool_or(v <> 0 AND band = 0) OVER (PARTITION BY query_id) AS any_boost FROM b),
y AS (SELECT query_id, paper_id, rank, round(boosted, 9) AS boosted, row_number() OVER (PARTITION BY query_id ORDER BY band, CASE WHEN band = 0 AND any_boost THEN -boosted END, CASE WHEN band = 0 AND any_boost THEN paper_id END, rank)::INT AS new_rank FROM x)
SELECT *, new_rank - rank AS shift FROM y""")
def q8_boost(spark, d):
    """Q8, W10."""
    lex = R.term_overlap(_queries(spark, d), _chunks(spark, d))
    cats = lex.withColumn("categories", F.array(F.lit("none"), F.concat(F.lit("c"), (F.col("paper_id") % 4).cast("string")))).withColumnRenamed("score", "ranking_score")
    boosts = _queries(spark, d).select("query_id", F.create_map(F.lit("c0"), F.lit(0.4), F.lit("c1"), F.lit(-0.05)).alias("boosts"))
    return _shown(R.boost(cats, boosts), 9, "boosted")


@query(f"""WITH {_LEX}, req AS (SELECT query_id AS request_id FROM q), got AS (SELECT query_id AS request_id, paper_id FROM lex WHERE rank <= 20 AND query_id % 5 <> 0),
refs AS (SELECT query_id AS request_id, paper_id FROM lex WHERE rank <= 1 + query_id * 2 AND query_id % 7 <> 3),
a AS (SELECT request_id, count(*) AS refs, count(*) FILTER (WHERE g.paper_id IS NULL) AS missing FROM refs LEFT JOIN got g USING (request_id, paper_id) GROUP BY 1),
b AS (SELECT request_id, count(*) AS retrieved FROM got GROUP BY 1)
SELECT request_id, coalesce(refs, 0) AS refs, coalesce(missing, 0) AS missing, coalesce(retrieved, 0) AS retrieved,
 CASE WHEN coalesce(retrieved, 0) = 0 OR coalesce(refs, 0) = 0 THEN 'abstain' WHEN missing > 0 THEN 'block' ELSE 'pass' END AS verdict FROM req LEFT JOIN a USING (request_id) LEFT JOIN b USING (request_id)""")
def q12_grounding_verdict(spark, d):
    """Q12, J7."""
    lex = R.term_overlap(_queries(spark, d), _chunks(spark, d)).withColumnRenamed("query_id", "request_id")
    got = lex.where("rank <= 20 AND request_id % 5 <> 0")
    refs = lex.where("rank <= 1 + request_id * 2 AND request_id % 7 <> 3")
    return R.grounding_verdict(refs, got, _queries(spark, d).withColumnRenamed("query_id", "request_id"))


@query(f"""WITH {_LEX}, {_PHRASES.replace("c AS", "b AS")}, rel AS (SELECT DISTINCT item_id AS query_id, doc_id AS paper_id FROM i, b WHERE len(w) > 0 AND contains(body, ' ' || array_to_string(w, ' ') || ' '))
SELECT query_id, count(lex.paper_id) / count(*) AS recall FROM rel LEFT JOIN (SELECT * FROM lex WHERE rank <= 10) lex USING (query_id, paper_id) GROUP BY 1""")
def q19_recall_at_10(spark, d):
    """Q19, A10: documents that quote a whole item are its relevant set."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), _words("text").alias("phrase"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("paper_id"), _words("text").alias("tokens"))
    rel = R.phrase_match(items, docs, k=1_000_000_000).select("query_id", "paper_id")
    return R.recall_at(R.term_overlap(_queries(spark, d), _chunks(spark, d)), rel, 10)


@query(f"""WITH {_BM25} SELECT query_id, paper_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT query_id, paper_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM h WHERE 2010 + paper_id % 15 BETWEEN 2013 AND 2020) WHERE rank <= 150""")
def f10_bm25_of_years(spark, d):
    """the bounds leave the scores as they are over all chunks."""
    return _shown(R.bm25(_queries(spark, d), _chunks(spark, d), keep=(2010 + F.col("paper_id") % 15).between(2013, 2020)), 6)


@query("""SELECT doc_id AS paper_id, doc_id % 40 AS query_id, (CASE WHEN list_contains(w, 'the') THEN 1 ELSE 0 END + CASE WHEN list_contains(w, lang) THEN 1 ELSE 0 END)::DOUBLE AS score FROM (SELECT *, string_split_regex(lower(coalesce(text, '')), '\\s+') AS w FROM documents)""")
def q7b_term_rerank(spark, d):
    """Q7b."""
    docs = table(spark, d, "documents")
    return R.rerank_by_terms(docs.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("paper_id"), F.concat(F.lit("The the "), F.col("lang")).alias("query"), "text"))
