"""Retrieval in bulk: lexical and vector legs, collapse, rank fusion, rerank folding, boosts, grounding, evaluation.

Every operator takes many queries at once; ranks are windows by query, so no operator gathers all rows in one task.
Queries are a stated set: legs join them by term or by block, and only top-k rows of a query go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia_spark.session import ship_package

TOP_K, TOP_N, RRF_K = 150, 20, 60


def rank_by(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key."""
    return rank_by(df, keys, order, name).where(F.col(name) <= n)


def collapse(hits: DataFrame) -> DataFrame:
    """The best chunk of each paper for each query; ties by chunk id."""
    return top(hits, ["query_id", "paper_id"], [F.desc("score"), F.col("chunk_id")], 1, "_c").drop("_c")


def _best_papers(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best papers of each query (q), each by its best chunk; ties by chunk id."""
    rows = rows.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True], kind="stable", ignore_index=True).drop_duplicates(["q", "paper_id"])
    return rows[rows.groupby("q").cumcount() < k]


#: Hits that are added up at a time inside a task.
OVERLAP_HITS = 1 << 22


def _overlap(tokens: pa.Array, terms: pa.Array, starts: np.ndarray, asked: np.ndarray, n: int) -> np.ndarray:
    """Distinct terms of each of n queries among the tokens of each row; ``asked[starts[t]:starts[t + 1]]`` are the queries of term t."""
    flat = tokens.flatten()
    term = pc.fill_null(pc.index_in(flat, value_set=terms.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    row, term = np.divmod(np.unique(row[term >= 0] * len(terms) + term[term >= 0]), max(len(terms), 1))
    many = starts[term + 1] - starts[term]
    end = np.cumsum(many)
    counts, at = np.zeros(len(tokens) * n, np.int64), 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + OVERLAP_HITS, "right")))
        m = many[at:to]
        place = np.arange(m.sum()) + np.repeat(starts[term[at:to]] - (np.cumsum(m) - m), m)
        counts += np.bincount(np.repeat(row[at:to], m) * n + asked[place], minlength=len(counts))
        at = to
    return counts.reshape(len(tokens), n)


def term_overlap(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, most_queries: int = 10_000) -> DataFrame:
    """Number of distinct query terms among a chunk's tokens; one chunk a paper, k papers a query.

    queries: query_id, terms, a bounded set (checked) that all tasks hold; chunks: chunk_id, paper_id (neither null), tokens.
    Chunks keep their place: hits are counted a batch of chunks at a time, and a task carries the k best papers a query. A paper
    among the k best of all is among those of the task that holds its best chunk, so only these are shuffled.
    """
    ship_package(chunks.sparkSession)
    many = queries.count()
    if many > most_queries:
        raise ValueError(f"{many} queries; split them into sets of {most_queries}")
    each = queries.select("query_id", F.explode(F.array_compact(F.array_distinct("terms"))).alias("term")).toArrow()
    names, terms = (each[c].combine_chunks().dictionary_encode("encode") for c in ("query_id", "term"))
    asked, term = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (names, terms))
    starts = np.searchsorted(np.sort(term), np.arange(len(terms.dictionary) + 1))
    held = chunks.sparkSession.sparkContext.broadcast((names.dictionary, terms.dictionary, starts, asked[np.argsort(term, kind="stable")]))

    def run(batches):
        names, terms, starts, asked = held.value
        n, best, like = len(names), None, None
        least, last = np.zeros(n, np.int64), np.empty(n, object)  # of queries with k papers: score and chunk of the last one
        for batch in batches:
            if not n or not len(batch):
                continue
            like = batch.schema
            chunk, paper = (batch.column(c).to_pandas().to_numpy() for c in ("chunk_id", "paper_id"))
            counts = _overlap(batch.column("tokens"), terms, starts, asked, n)
            row, q = np.nonzero((counts > 0) & (counts >= least))
            score = counts[row, q]
            keep = score > least[q]
            ties = np.flatnonzero(~keep)
            keep[ties] = (chunk[row[ties]].astype(object) < last[q[ties]]).astype(bool)
            row, q, score = row[keep], q[keep], score[keep]
            new = pd.DataFrame({"q": q, "score": score, "chunk_id": chunk[row], "paper_id": paper[row]})
            best = _best_papers(new if best is None else pd.concat([best, new]), k)
            full = best.groupby("q").agg(n=("score", "size"), score=("score", "last"), chunk=("chunk_id", "last"))
            full = full[full["n"] >= k]
            least[full.index.to_numpy()], last[full.index.to_numpy()] = full["score"].to_numpy(), full["chunk"].to_numpy(object)
        if best is not None:
            ids = [pa.array(best[c].to_numpy(), like.field(c).type, from_pandas=True) for c in ("paper_id", "chunk_id")]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best["q"].to_numpy())), *ids, pa.array(best["score"].to_numpy(float))], ["query_id", "paper_id", "chunk_id", "score"])

    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *chunks.schema]}
    schema = ", ".join(f"{c} {types[c]}" for c in ("query_id", "paper_id", "chunk_id")) + ", score double"
    hits = chunks.select("chunk_id", "paper_id", "tokens").mapInArrow(run, schema).repartition("paper_id")
    return top(collapse(hits), ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


#: Stands in the postings once a chunk, so that statistics come from the pass that counts terms. No token is empty.
_EACH = ""


def _field_hits(q: DataFrame, chunks: DataFrame, field: str, k1: float, b: float) -> DataFrame:
    """query_id, paper_id, chunk_id, score of one field. Chunks without a token there don't count for its statistics.

    Chunks come dealt by paper, so terms are counted and hits are added up where their chunk lies; the weights of the query terms
    are sent to all. Texts are read once: the three uses of ``tf`` share the exchange that deals chunks. They read the same
    columns and filter only behind an aggregate, as otherwise the plans differ and nothing is shared.
    """
    wanted = q.select("term").distinct()
    wanted = wanted.unionByName(wanted.sparkSession.range(1).select(F.lit(_EACH).alias("term")))
    each = F.explode(F.when(F.size(field) > 0, F.concat(F.array(F.lit(_EACH)), F.col(field)))).alias("term")
    postings = chunks.select("chunk_id", "paper_id", "_keep", F.size(field).alias("len"), each).where("term IS NOT NULL")
    tf = postings.join(F.broadcast(wanted), "term", "left_semi").groupBy("term", "chunk_id", "paper_id", "_keep", "len").agg(F.count("*").alias("tf"))
    found, one = F.col("tf") > 0, F.col("term") == _EACH
    stats = tf.agg(F.count_if(one & found).alias("docs"), F.avg(F.when(one & found, F.col("len"))).alias("mean"))
    df = tf.groupBy("term").agg(F.count_if(found).alias("df"))
    weights = df.where(~one).join(q, "term")  # a row for a query and a term of it
    scored = tf.join(F.broadcast(weights), "term").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    # added up in the order of the terms, so that equal texts have equal scores
    parts = F.array_sort(F.collect_list(F.struct("term", part.alias("part")))).alias("parts")
    hits = scored.groupBy("query_id", "paper_id", "chunk_id").agg(parts, F.bool_and("_keep").alias("kept")).where("kept")
    return hits.select("query_id", "paper_id", "chunk_id", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"]).alias("score"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, k1: float = 1.2, b: float = 0.75, keep: Column | None = None, fields: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """BM25 over fields of tokens, the best field of a chunk counts; statistics over all chunks, postings of query
    terms only. ``keep`` limits what is found, not what is counted."""
    chunks = chunks.withColumn("_keep", F.lit(True) if keep is None else F.coalesce(keep, F.lit(False)))
    chunks = chunks.select("chunk_id", "paper_id", "_keep", *fields).repartition("paper_id")
    q = queries.select("query_id", F.explode(F.array_remove(F.array_distinct("terms"), _EACH)).alias("term"))
    each = [_field_hits(q, chunks, f, k1, b) for f in fields]
    hits = each[0]
    for other in each[1:]:
        hits = hits.unionByName(other)
    if len(each) > 1:
        hits = hits.groupBy("query_id", "paper_id", "chunk_id").agg(F.max("score").alias("score"))
    return top(collapse(hits), ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


#: Lengths of the runs of tokens by which phrases are looked up: each by the longest that fits in.
LEADS = (4, 2, 1)


def _run_keys(tokens: str, pos: str) -> list[Column]:
    """Hashes of the runs that begin at a place, one for each of ``LEADS``; tokens behind the end are left out."""
    return [F.xxhash64(*[F.get(tokens, F.col(pos) + i) for i in range(n)]) for n in LEADS]


def phrase_match(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, fields: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """Chunks that hold the phrase as a run of tokens in one of their fields; one chunk a paper, k papers a query.

    queries: query_id, phrase (array of tokens), and where wanted paper_ids (array: only these papers), since and until (years,
    inclusive); chunks: chunk_id, paper_id, arrays of tokens, and year where years are asked for.

    Queries are a stated set that all tasks hold. Each is looked up by a run of four of its tokens (two or one in shorter phrases),
    the one that the fewest phrases hold; where a chunk holds that run, its tokens there are compared with the whole phrase.
    Texts are read once and stay where they are, and only hits are shuffled. So a phrase costs the places of its run. Phrases
    that are null, empty or hold a null find nothing; null and empty tokens of chunks end a run.
    """
    narrowed = [c for c in ("paper_ids", "since", "until") if c in queries.columns]
    whole = queries.where(F.size("phrase") > 0).where(~F.exists("phrase", lambda t: F.coalesce(t, F.lit("")) == ""))
    size = F.size("phrase")
    at_least = lambda values: F.coalesce(*[F.when(size >= n, v) for n, v in zip(LEADS, values)])
    runs = whole.select("query_id", "phrase", F.posexplode("phrase").alias("at", "_t")).where(F.col("at") + at_least([F.lit(n) for n in LEADS]) <= size)
    runs = runs.select("query_id", "at", at_least(_run_keys("phrase", "at")).alias("key"))
    leads = runs.join(runs.groupBy("key").agg(F.countDistinct("query_id").alias("held")), "key").groupBy("query_id").agg(F.min(F.struct("held", "at", "key")).alias("lead"))
    leads = leads.select("query_id", "lead.key", "lead.at").join(whole.select("query_id", "phrase", *narrowed), "query_id")
    hits, start = None, F.col("pos") - F.col("at")
    for field in fields:
        rows = chunks.select("chunk_id", "paper_id", *[c for c in ("year",) if c in chunks.columns], F.col(field).alias("_tokens"))
        # outer, as for a plain one Spark would test each array first, and so split each text more than once
        places = rows.select("*", F.posexplode_outer("_tokens").alias("pos", "_t")).drop("_t").withColumn("key", F.explode(F.array(*_run_keys("_tokens", "pos"))))
        found = places.join(F.broadcast(leads), "key").where(F.when(start >= 0, F.slice("_tokens", start + 1, size) == F.col("phrase")))
        for c, fits in (("paper_ids", F.array_contains("paper_ids", F.col("paper_id"))), ("since", F.col("year") >= F.col("since") if "since" in narrowed else None), ("until", F.col("year") <= F.col("until") if "until" in narrowed else None)):
            if c in narrowed:
                found = found.where(F.col(c).isNull() | fits)
        found = found.select("query_id", "paper_id", "chunk_id")
        hits = found if hits is None else hits.unionByName(found)
    best = hits.groupBy("query_id", "paper_id").agg(F.min("chunk_id").alias("chunk_id")).withColumn("score", F.lit(1.0))
    return top(best, ["query_id"], [F.col("chunk_id")], k)


def _unit(vectors: list) -> np.ndarray:
    m = np.array(vectors, np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def _near(units: np.ndarray, wanted: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of each query's k best rows and what ties with the last of them, where not below ``least`` of the query.

    The product of blocks picks; what it picks is added up anew one pair at a time, so that equal vectors have equal scores.
    """
    rough = wanted @ units.T
    if rough.shape[1] > k:
        least = np.maximum(least, np.partition(rough, -k, axis=1)[:, -k])
    q, row = np.nonzero(rough >= least[:, None] - 1e-9)
    return q, row, (wanted[q] * units[row]).sum(axis=1)


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each query (q), ties by chunk id."""
    rows = rows.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True], kind="stable", ignore_index=True)
    return rows[rows.groupby("q").cumcount() < k]


#: Rows and queries of one product inside a task.
KNN_ROWS, KNN_QUERIES = 4_096, 256


def knn(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, most_queries: int = 10_000) -> DataFrame:
    """Q1: exact cosine neighbours of a bounded query set (checked), each against all chunks; then one chunk a paper.

    Chunks keep their place; blocks of them are multiplied with the query vectors, which all tasks hold. A task carries the k best
    a query over its blocks, so k rows a query leave it however many blocks it has. Vectors without a length are near
    nothing: their cosine is 0. Null vectors are left out.
    """
    ship_package(chunks.sparkSession)
    n = queries.count()
    if n > most_queries:
        raise ValueError(f"{n} queries; split them into sets of {most_queries}")
    wanted = queries.where("vector IS NOT NULL").select("query_id", "vector").toPandas()
    names = wanted["query_id"].to_numpy()
    held = chunks.sparkSession.sparkContext.broadcast(_unit(wanted["vector"].tolist()) if len(wanted) else None)

    def gathered(blocks):
        some, n = [], 0
        for pdf in blocks:
            some.append(pdf.assign(vector=list(_unit(pdf["vector"].tolist()))) if len(pdf) else pdf)
            n += len(pdf)
            if n >= KNN_ROWS:
                yield pd.concat(some)
                some, n = [], 0
        if n:
            yield pd.concat(some)

    def run(blocks):
        if held.value is None:
            return
        best, least = {}, np.full(len(names), -np.inf)
        for pdf in gathered(blocks):
            units, chunk, paper = np.stack(pdf["vector"].tolist()), pdf["chunk_id"].to_numpy(), pdf["paper_id"].to_numpy()
            for a in range(0, len(names), KNN_QUERIES):  # a slice of the queries at a time: the product is small however many there are
                q, row, score = _near(units, held.value[a : a + KNN_QUERIES], k, least[a : a + KNN_QUERIES])
                new = pd.DataFrame({"q": q + a, "score": score, "chunk_id": chunk[row], "paper_id": paper[row]})
                best[a] = _best(pd.concat([best[a], new]) if a in best else new, k)
                full = best[a].groupby("q")["score"].agg(["size", "min"])
                full = full[full["size"] >= k]
                least[full.index.to_numpy()] = full["min"].to_numpy()
        for b in best.values():
            yield pd.DataFrame({"query_id": names[b["q"].to_numpy()], "paper_id": b["paper_id"].to_numpy(), "chunk_id": b["chunk_id"].to_numpy(), "score": b["score"].to_numpy()})

    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *chunks.schema]}
    schema = ", ".join(f"{c} {types[c]}" for c in ("query_id", "paper_id", "chunk_id")) + ", score double"
    hits = chunks.where("vector IS NOT NULL").select("paper_id", "chunk_id", "vector").mapInPandas(run, schema)
    return collapse(top(hits, ["query_id"], [F.desc("score"), F.col("chunk_id")], k, "_k").drop("_k"))


def fuse(*legs: DataFrame, k: int = RRF_K) -> DataFrame:
    """Q4: reciprocal rank fusion; a paper counts once a list with its best rank (1-based), ties by paper id."""
    lists = None
    for i, leg in enumerate(legs):
        one = leg.select("query_id", "paper_id", F.lit(i).alias("list"), (1.0 / (k + F.col("rank"))).alias("part"))
        lists = one if lists is None else lists.unionByName(one)
    best = lists.groupBy("query_id", "paper_id", "list").agg(F.max("part").alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("list", "part")))  # one a list
    fused = best.groupBy("query_id", "paper_id").agg(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["part"]).alias("score"), F.min_by("list", F.struct((-F.col("part")).alias("p"), "list")).alias("from_list"))
    return rank_by(fused, ["query_id"], [F.desc("score"), F.col("paper_id")])


def no_match_floor(ranked: DataFrame, best: DataFrame, floor: float) -> DataFrame:
    """queries whose best raw vector score is known and below the floor give nothing."""
    low = best.groupBy("query_id").agg(F.max("score").alias("s")).where((F.lit(floor) > 0) & (F.col("s") < floor)).select("query_id")
    return ranked.join(low, "query_id", "left_anti")


def fold_rerank(ranked: DataFrame, width: int) -> DataFrame:
    """Q7: rerank scores order the first ``width`` rows; the rest stays below them in its order. ranked: query_id, rank, rerank."""
    w = Window.partitionBy("query_id")
    head = F.col("rank") <= width
    floor = F.min(F.when(head, F.col("rerank"))).over(w)
    tail = F.sum(F.when(head, 0).otherwise(1)).over(w)
    score = F.when(head, F.col("rerank")).otherwise(floor - F.lit(1e-3) / tail * (F.col("rank") - width))
    out = ranked.withColumn("ranking_score", score)
    return rank_by(out, ["query_id"], [F.desc("ranking_score"), F.col("paper_id")], "final_rank")


def boost(ranked: DataFrame, boosts: DataFrame, share: float = 0.3, ceiling: float = 0.1) -> DataFrame:
    """Q8: the top band (30 %, 2 at least) is ordered anew by score + |score| * boost of the first category that has one, ties by paper id.

    ranked: query_id, paper_id, rank, ranking_score, categories; boosts: query_id, boosts map. Other rows keep their place, and
    so do all rows of a query whose band has no boost.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    band = F.least(n, F.greatest(F.lit(2), F.ceil(n * share)))
    hit = F.try_element_at(F.filter("categories", lambda c: F.map_contains_key("boosts", c)), F.lit(1))
    value = F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), F.coalesce(F.try_element_at("boosts", hit), F.lit(0.0))))
    df = ranked.join(boosts, "query_id", "left").withColumn("band", F.when(F.col("rank") <= band, 0).otherwise(1))
    df = df.withColumn("value", F.when(F.col("band") == 0, value).otherwise(0.0))
    df = df.withColumn("moves", F.max(F.col("value") != 0).over(Window.partitionBy("query_id")) & (F.col("band") == 0))
    df = df.withColumn("boosted", F.col("ranking_score") + F.abs("ranking_score") * F.col("value"))
    order = [F.col("band"), F.when(F.col("moves"), -F.col("boosted")), F.when(F.col("moves"), F.col("paper_id")), F.col("rank")]
    out = rank_by(df, ["query_id"], order, "new_rank")
    return out.select("query_id", "paper_id", "rank", "boosted", "new_rank", (F.col("new_rank") - F.col("rank")).alias("shift"))


def grounding_verdict(refs: DataFrame, retrieved: DataFrame, requests: DataFrame) -> DataFrame:
    """Abstain without retrieved rows or references, block on a reference outside the retrieved rows, else pass."""
    known = retrieved.select("request_id", "paper_id").distinct().withColumn("known", F.lit(True))
    seen = refs.join(known, ["request_id", "paper_id"], "left").groupBy("request_id").agg(F.count("*").alias("refs"), F.count_if(F.col("known").isNull()).alias("missing"))
    got = known.groupBy("request_id").agg(F.count("*").alias("retrieved"))
    all_ = requests.select("request_id").join(seen, "request_id", "left").join(got, "request_id", "left").na.fill(0)
    verdict = F.when((F.col("retrieved") == 0) | (F.col("refs") == 0), "abstain").when(F.col("missing") > 0, "block").otherwise("pass")
    return all_.select("request_id", "refs", "missing", "retrieved", verdict.alias("verdict"))


def recall_at(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Q19, A10: share of each query's relevant papers among its first k."""
    hit = relevant.join(ranked.where(F.col("rank") <= k).select("query_id", "paper_id", F.lit(1).alias("hit")), ["query_id", "paper_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def rerank_by_terms(pairs: DataFrame) -> DataFrame:
    """Pairs (query_id, paper_id, query, text): distinct words of the query that the text holds."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), ""))
    return pairs.select("query_id", "paper_id", F.size(F.array_intersect(words("query"), words("text"))).cast("double").alias("score"))
