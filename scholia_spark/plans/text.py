"""Scalar operators over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia_spark.functions import ids, tex, text
from scholia_spark.plans.base import query, table


@query("""SELECT doc_id, norm, lower(regexp_replace(text, '[^0-9A-Za-z]+', '', 'g')) AS alnum,
  CASE WHEN length(norm) <= 280 THEN norm ELSE rtrim(substr(norm, 1, 279)) || '...' END AS snip,
  greatest(1, length(text) // 4) AS est, greatest(1, length(text) * 2 // 7) AS rate,
  len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))::BIGINT AS n_tokens
FROM (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS norm FROM documents)""")
def x_text_scalars(spark, d):
    """X1, X4, X18, X19, X20, X21."""
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", text.normalize_text(t).alias("norm"), text.alnum_key(t).alias("alnum"), text.snippet(t).alias("snip"),
        text.estimate_tokens(t).alias("est"), text.rate_tokens(t).alias("rate"), F.size(text.tokens(t)).cast("long").alias("n_tokens"),
    )


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0e-\\x1f\\x7f]') THEN 'control' WHEN n = '' THEN 'empty' WHEN length(n) > 500 THEN 'too_long' ELSE 'ok' END AS status
FROM (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM documents)""")
def f1_query_validation(spark, d):
    return table(spark, d, "documents").select("doc_id", text.query_status(F.col("text")).alias("status"))


_LICENSES = """VALUES (0, 'https://creativecommons.org/licenses/by/4.0/'), (1, 'http://arxiv.org/licenses/nonexclusive-distrib/1.0/'), (2, 'cc_by'), (3, 'CC BY SA'),
  (4, 'https://creativecommons.org/licenses/by-nc/4.0/'), (5, 'ftp://creativecommons.org/licenses/by/4.0/'), (6, 'cc0'), (7, ''), (8, 'https://example.org/licenses/by/')"""


@query(f"""WITH l AS (SELECT doc_id, v.value FROM documents JOIN ({_LICENSES}) v(k, value) ON doc_id % 9 = k),
p AS (SELECT *, lower(regexp_extract(value, '^https?://([^/:?#]*)', 1)) AS h, lower(regexp_extract(value, '^https?://[^/?#]*(/[^?#]*)', 1)) AS pa, replace(replace(lower(value), '_', '-'), ' ', '-') AS cc FROM l)
SELECT doc_id, (h = 'creativecommons.org' AND (starts_with(pa, '/licenses/by/') OR starts_with(pa, '/licenses/by-sa/') OR starts_with(pa, '/publicdomain/zero/'))) OR (h = 'arxiv.org' AND starts_with(pa, '/licenses/nonexclusive-distrib')) AS allowed,
CASE WHEN (h = 'creativecommons.org' AND (starts_with(pa, '/licenses/') OR starts_with(pa, '/publicdomain/'))) OR (h = 'arxiv.org' AND starts_with(pa, '/licenses/nonexclusive')) THEN value
 WHEN cc IN ('cc-by', 'ccby') THEN 'https://creativecommons.org/licenses/by/4.0/' WHEN cc IN ('cc-by-sa', 'ccbysa') THEN 'https://creativecommons.org/licenses/by-sa/4.0/'
 WHEN cc IN ('cc0', 'cc-zero') THEN 'https://creativecommons.org/publicdomain/zero/1.0/' END AS canonical FROM p""")
def f2_f3_licenses(spark, d):
    names = spark.sql(f"SELECT * FROM ({_LICENSES}) AS v(k, value)")
    docs = table(spark, d, "documents").select("doc_id")
    joined = docs.join(F.broadcast(names), F.col("doc_id") % 9 == F.col("k"))
    return joined.select("doc_id", text.license_allowed(F.col("value")).alias("allowed"), text.license_url(F.col("value")).alias("canonical"))


@query("""SELECT doc_id, regexp_matches(lower(CASE WHEN doc_id % 10 = 0 THEN 'Note: This paper has been WITHDRAWN. ' ELSE '' END || ' ' || text),
 'this paper has been withdrawn|this article has been withdrawn|withdrawn by the author|withdrawn by authors|paper withdrawn') AS withdrawn FROM documents""")
def f6_withdrawal(spark, d):
    title = F.when(F.col("doc_id") % 10 == 0, "Note: This paper has been WITHDRAWN. ").otherwise("")
    return table(spark, d, "documents").select("doc_id", text.withdrawn(title, F.col("text")).alias("withdrawn"))


@query("""SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT (regexp_matches(x, '^\\s*\\d{1,4}\\s*$') OR
 (length(trim(x)) <= 200 AND regexp_matches(x, '(?i)\\b(copyright|\\(c\\)|©|all rights reserved)\\b|^\\s*(corresponding author|affiliation|e-?mail)\\b|^\\s*(preprint|under review|to appear in|arxiv:)\\b')))), chr(10)) AS body
FROM (SELECT doc_id, text || chr(10) || (doc_id % 5000)::VARCHAR || chr(10) || 'Copyright 2020 by us' || chr(10) || 'E-mail us' AS t FROM documents)""")
def f18_noise_lines(spark, d):
    t = F.concat("text", F.lit("\n"), (F.col("doc_id") % 5000).cast("string"), F.lit("\nCopyright 2020 by us\nE-mail us"))
    return table(spark, d, "documents").select("doc_id", text.strip_noise_lines(t).alias("body"))


_REFS = "VALUES (0, 'https://arxiv.org/abs/%sv3'), (1, 'arXiv:%s'), (2, '%s.pdf'), (3, 'bad/%s'), (4, 'www.arxiv.org/pdf/%sv12.pdf')"


@query(f"""WITH r AS (SELECT doc_id, replace(f, '%s', printf('%02d%02d.%05d', 10 + doc_id % 15, 1 + doc_id % 12, doc_id)) AS raw FROM documents JOIN ({_REFS}) v(k, f) ON doc_id % 5 = k),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^(?:https?://)?(?:www\\.)?arxiv\\.org/(?:abs|pdf)/', '', 'i'), '^arxiv:', '', 'i'), '\\.pdf$', '', 'i'), '^/+|/+$', '', 'g') AS ref FROM r),
c AS (SELECT doc_id, regexp_replace(ref, '^(.+?)v[1-9][0-9]*$', '\\1') AS base, regexp_extract(ref, '^.+?v([1-9][0-9]*)$', 1) AS v FROM b),
e AS (SELECT doc_id, CASE WHEN regexp_matches(base, '^(?:[0-9]{{4}}\\.[0-9]{{4,5}}|[a-z-]+(?:\\.[A-Z]{{2}})?/[0-9]{{7}})$', 'i') THEN base END AS paper_id, CASE WHEN v = '' THEN 1 ELSE v::INT END AS ver FROM c)
SELECT doc_id, paper_id, CASE WHEN paper_id IS NOT NULL THEN ver END AS version, 2000 + nullif(regexp_extract(paper_id, '^([0-9]{{2}})[0-9]{{2}}\\.[0-9]{{4,5}}$', 1), '')::INT AS year,
 CASE WHEN paper_id IS NOT NULL THEN sha256(paper_id || ':v' || ver) END AS fingerprint, paper_id || '#' || (doc_id % 7) AS chunk FROM e""")
def x5_x7_arxiv_ids(spark, d):
    """X5, X6, X7, X17."""
    forms = spark.sql(f"SELECT * FROM ({_REFS}) AS v(k, f)")
    docs = table(spark, d, "documents").select("doc_id").join(F.broadcast(forms), F.col("doc_id") % 5 == F.col("k"))
    bare = F.format_string("%02d%02d.%05d", 10 + F.col("doc_id") % 15, 1 + F.col("doc_id") % 12, F.col("doc_id"))
    docs = docs.select("doc_id", ids.arxiv_ref(F.replace("f", F.lit("%s"), bare)).alias("ref")).select("doc_id", "ref.*")
    return docs.select("doc_id", "paper_id", "version", ids.year_of(F.col("paper_id")).alias("year"), ids.fingerprint(F.col("paper_id"), F.col("version")).alias("fingerprint"), ids.chunk_id(F.col("paper_id"), F.col("doc_id") % 7).alias("chunk"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doi:10.1/' || doc_id WHEN doc_id % 3 = 1 THEN 'arxiv:2101.' || lpad(doc_id::VARCHAR, 5, '0')
 ELSE 'title:' || substr(sha256(lower(trim(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g'))) || '|' || source || '|' || (2000 + doc_id % 20)), 1, 24) END AS canonical_key FROM documents""")
def x8_canonical_key(spark, d):
    i = F.col("doc_id")
    doi = F.when(i % 3 == 0, F.concat(F.lit(" 10.1/"), i.cast("string")))
    arxiv = F.when(i % 3 == 1, F.concat(F.lit("2101."), F.lpad(i.cast("string"), 5, "0"), F.lit("v2")))
    key = ids.canonical_key(F.substring("text", 1, 60), 2000 + i % 20, doi, arxiv, F.col("source"))
    return table(spark, d, "documents").select("doc_id", key.alias("canonical_key"))


@query("""SELECT doc_id, regexp_extract_all(text, '\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?') AS numbers, len(regexp_extract_all(text, '\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?'))::BIGINT AS n FROM documents""")
def n1_numbers(spark, d):
    found = text.summary_numbers(F.col("text"))
    return table(spark, d, "documents").select("doc_id", found.alias("numbers"), F.size(found).cast("long").alias("n"))


@query("""SELECT page_id, (page_id % 7 + 1) * 3.0 / 1e6 + (page_id % 11) * 15.0 / 1e6 AS usd,
 greatest(0.0, least(page_id % 10 + 5.0, 9.0) - greatest((page_id % 10)::DOUBLE, 4.0)) * greatest(0.0, least(8.0, page_id % 6 + 3.0) - greatest(2.0, (page_id % 6)::DOUBLE)) AS area FROM pages""")
def n7_n9_arithmetic(spark, d):
    i = F.col("page_id")
    a = [(i % 10).cast("double"), (i % 6).cast("double"), i % 10 + 5.0, i % 6 + 3.0]
    b = [F.lit(4.0), F.lit(2.0), F.lit(9.0), F.lit(8.0)]
    return table(spark, d, "pages").select("page_id", text.usd_estimate(i % 7 + 1, i % 11).alias("usd"), text.box_overlap(a, b).alias("area"))


@query("""WITH w AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS word FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda y: y <> '') AS x FROM documents))
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS abstract FROM w GROUP BY doc_id""")
def src19_inverted_abstract(spark, d):
    """SRC19: a map word -> positions is turned back into text. Texts are dealt by id once, so that no shuffle has words."""
    words = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.array_remove(F.split("text", r"\s+"), "")).alias("p", "w"))
    index = words.groupBy("doc_id", "w").agg(F.collect_list("p").alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return index.select("doc_id", text.inverted_text(F.col("index")).alias("abstract"))


@query("""WITH w AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS word FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda y: y <> '') AS x FROM documents)),
f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, word) AS entry FROM w), s AS (SELECT doc_id, pos // 2 AS slot, arg_max(word, entry) AS word FROM f GROUP BY ALL)
SELECT doc_id, string_agg(word, ' ' ORDER BY slot) AS abstract FROM s GROUP BY doc_id""")
def src20_one_word_a_position(spark, d):
    """SRC20: two neighbours share a position, and the later entry of the map stays. Texts are dealt by id once, as for SRC19."""
    words = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.array_remove(F.split("text", r"\s+"), "")).alias("p", "w"))
    entry = words.groupBy("doc_id", "w").agg(F.min("p").alias("first"), F.collect_set(F.expr("(p + 1) div 2")).alias("at"))
    entries = entry.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "w", "at"))).alias("e"))
    index = F.map_from_entries(F.transform("e", lambda x: F.struct(x["w"], x["at"])))
    return entries.select("doc_id", text.inverted_text_of_slots(index).alias("abstract"))


@query("""SELECT doc_id, '\\mathbb{R}' AS r, '\\operatorname*{arg' || doc_id || '}' AS op, '\\frac{#1}{#2}' AS f, 3::BIGINT AS n FROM documents""")
def x36_macros(spark, d):
    source = F.concat(F.lit("\\newcommand{\\R}{\\mathbb{R}} % \\newcommand{\\no}{x}\n\\DeclareMathOperator*{\\op}{arg"), F.col("doc_id").cast("string"), F.lit("}\\def\\f#1#2{\\frac{#1}{#2}}\\newcommand\\bad{\\href{u}{x}}\\newcommand{\\open}{"))
    found = table(spark, d, "documents").select("doc_id", tex.macros(source).alias("m"))
    return found.select("doc_id", *[F.col("m")[k].alias(n) for k, n in (("\\R", "r"), ("\\op", "op"), ("\\f", "f"))], F.size("m").cast("long").alias("n"))
