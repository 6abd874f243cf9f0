"""Table repair with proofs, preservation audits, band quotas and bookkeeping of stored papers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia_spark.operators.records import cell_numbers

#: Shortest caption and shortest agreement that identify a table, in letters and digits.
MIN_AGREEMENT = 30


def agreement(spec: Column, read: Column, least: int = MIN_AGREEMENT) -> Column:
    """Length of the whole ``spec`` where ``read`` quotes it, else of its longest start that ``read`` ends with (``least`` or more), else 0."""
    ceiling = F.least(F.length(spec), F.length(read))
    lengths = F.when(ceiling >= least, F.sequence(ceiling, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    ends = F.filter(lengths, lambda n: F.endswith(read, F.left(spec, n)))
    return F.when((spec != "") & F.contains(read, spec), F.length(spec)).otherwise(F.coalesce(F.try_element_at(ends, F.lit(1)), F.lit(0)))


def caption_key(caption: Column) -> Column:
    """Letters and digits of a caption without its label, in lower case."""
    bare = F.regexp_replace(F.coalesce(caption, F.lit("")), r"(?i)^\s*(?:table|tab\.?|figure|fig\.?)\s*(?:\d+|[ivxlcdm]+)\s*[:.]?", "")
    return F.lower(F.regexp_replace(bare, "[^0-9A-Za-z]+", ""))


def caption_match(specs: DataFrame, tables: DataFrame) -> DataFrame:
    """Specs (spec_id, page_key, caption), tables (table_id, page_key, caption): the table of the page with the longest agreement, if it is alone. The join is on the page."""
    a = specs.select("spec_id", "page_key", caption_key(F.col("caption")).alias("a")).where(F.length("a") >= MIN_AGREEMENT)
    b = tables.select("table_id", "page_key", caption_key(F.col("caption")).alias("b"))
    scored = a.join(b, "page_key").withColumn("n", agreement(F.col("a"), F.col("b"))).where(F.col("n") >= MIN_AGREEMENT)
    best = scored.groupBy("spec_id", "n").agg(F.count("*").alias("ties"), F.min("table_id").alias("table_id")).groupBy("spec_id").agg(F.max(F.struct("n", "ties", "table_id")).alias("m"))
    return best.where("m.ties = 1").select("spec_id", "m.table_id", F.col("m.n").alias("agreed"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{2,}"), 0)


def _proof(old: Column, new: Column, printed: Column, reversible: Column | None) -> Column:
    known = lambda t: F.array_contains(printed, t) | (F.array_contains(reversible, F.reverse(t)) if reversible is not None else F.lit(False))
    return (F.size(new) > 0) & (F.size(new) >= F.size(old)) & F.forall(new, known)


def rebuild_proven(cells: Column, rebuilt: Column, page: Column, rotated: Column) -> Column:
    """The rebuilt cells hold no fewer numbers and words than the old ones, and each is printed on the page.

    Only words may be printed reversed, in the ``rotated`` runs. A kind of token that the rebuild lacks is not asked for; without any kind it is refused.
    """
    flat = lambda a, f: F.flatten(F.transform(a, f))
    new_numbers, new_words = flat(rebuilt, cell_numbers), flat(rebuilt, _words)
    numbers = _proof(flat(cells, cell_numbers), new_numbers, F.regexp_extract_all(F.translate(page, "−–", "--"), F.lit(r"-?\d+(?:\.\d+)?"), 0), None)
    words = _proof(flat(cells, _words), new_words, _words(page), flat(rotated, _words))
    some = (F.size(new_numbers) > 0) | (F.size(new_words) > 0)
    return (F.trim(page) != "") & some & (numbers | (F.size(new_numbers) == 0)) & (words | (F.size(new_words) == 0))


def apply_repairs(blocks: DataFrame, by_region: DataFrame, by_caption: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks (spec_id, cells) take the rebuilt cells of the table that their region names, else their caption, if the proof holds. tables: table_id, rebuilt, page, rotated."""
    named = blocks.join(by_region.select("spec_id", F.col("table_id").alias("_r")), "spec_id", "left").join(by_caption.select("spec_id", F.col("table_id").alias("_c")), "spec_id", "left")
    both = named.withColumn("table_id", F.coalesce("_r", "_c")).join(tables, "table_id", "left")
    ok = F.coalesce(rebuild_proven(F.col("cells"), F.col("rebuilt"), F.col("page"), F.col("rotated")), F.lit(False))
    return both.select("spec_id", F.when(ok, F.col("rebuilt")).otherwise(F.col("cells")).alias("cells"), ok.alias("repaired"))


#: Types of violations in their order, with the condition over an audit's signals.
AUDIT_RULES = (
    ("figure_lost", "lost_figures > 0"), ("table_lost", "lost_tables > 0"), ("caption_text_dropped", "captions_dropped > 0"), ("empty_table", "empty_tables > 0"),
    ("figure_missing_assetref", "figures_without_asset > 0"), ("coverage_low", "coverage < {least}"), ("crop_missing", "crops_refused > crops_refused_by_design"),
    ("crop_unaccounted", "crop_specs <> crops_stored + crops_refused"), ("crop_geometry_error", "geometry_error"), ("crop_duplicate", "crop_duplicates > 0"),
    ("table_cells_merged", "cells_merged > 0"), ("float_label_unreadable", "labels_unreadable > 0"),
)


def audit_violations(least: float = 0.5) -> Column:
    """What a paper's signals show, by rule; null signals count as unmeasured."""
    return F.array_compact(F.array(*[F.when(F.expr(rule.format(least=least)), name) for name, rule in AUDIT_RULES]))


def band_quota(ranked: DataFrame, buckets: list[tuple[str, int]], frontier: int, recent: int, shares: tuple[float, float]) -> DataFrame:
    """Ranked (id, year, score, buckets) fill the buckets in turn; each takes its newest bands by share, then the rest, and leaves what an earlier bucket took.

    The loop runs over the few buckets, not over rows; each band is a top-k, ranked in every task before a bounded number of rows meets.
    """
    band = F.when(F.col("year") >= frontier, 0).when(F.col("year") >= recent, 1).otherwise(2)
    chosen = None
    for name, target in buckets:
        pool = ranked.where(F.array_contains("buckets", name)).select("id", "year", "score", band.alias("band"))
        if chosen is not None:
            pool = pool.join(chosen.select("id"), "id", "left_anti")
        order = [F.desc("score"), F.col("id")]
        caps = enumerate((int(target * shares[0]), int(target * shares[1]), target))
        kept = functools.reduce(DataFrame.unionByName, [pool.where(F.col("band") == k).orderBy(*order).limit(cap) for k, cap in caps])
        first = kept.orderBy("band", *order).limit(target).select("id", F.lit(name).alias("bucket"))
        chosen = first if chosen is None else chosen.unionByName(first)
    return chosen


def embed_text(section: Column, abstract: Column, terms: Column, title: Column) -> Column:
    """SNK7: abstract rows embed the abstract; others their terms, else the abstract, else the title."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    rest = F.coalesce(some(terms), some(abstract), some(title), F.lit(""))
    return F.when(section == "abstract", F.coalesce(some(abstract), rest)).otherwise(rest)


def parsed_year(paper_id: Column, published: Column, updated: Column) -> Column:
    """The year of a YYMM id, else of the publication, else of the update."""
    yy = F.regexp_extract(F.coalesce(paper_id, F.lit("")), r"^(\d{2})\d{2}\.\d{4,5}", 1)
    return F.when(yy != "", 2000 + yy.try_cast("int")).otherwise(F.year(F.coalesce(published, updated)))


def heading_sections(text: Column) -> Column:
    """Array of (section, body): titles in lower case, text before the first heading goes; without headings one ``body``."""
    body = F.coalesce(text, F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.split(body, r"(?m)(?=^[A-Z][A-Za-z0-9 ,.()/_:-]{2,80}$)")
    headed = F.filter(parts, lambda p: F.regexp_like(p, F.lit(r"^[A-Z][A-Za-z0-9 ,.()/_:-]{2,80}(?:\n|$)")))
    pairs = F.transform(headed, lambda p: F.struct(F.lower(F.trim(F.split_part(p, F.lit("\n"), F.lit(1)))).alias("section"), strip(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))
    return F.when(F.size(headed) > 0, pairs).otherwise(F.array(F.struct(F.lit("body").alias("section"), strip(body).alias("body"))))


def assemble_records(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunks (paper_id, ordinal, section, text) with their paper's title and abstract; abstract chunks carry no terms."""
    terms = F.when(F.col("section") == "abstract", "").otherwise(F.col("text"))
    return chunks.join(papers.select("paper_id", "title", "abstract"), "paper_id").select("paper_id", "ordinal", "section", "title", "abstract", terms.alias("lexical_terms"))


def record_duplicates(states: DataFrame, arrivals: DataFrame) -> DataFrame:
    """States (canonical_key, seen_sources) joined by the sources of arrivals (canonical_key, source), each once, sorted."""
    new = arrivals.groupBy("canonical_key").agg(F.collect_set("source").alias("_new"))
    both = states.join(new, "canonical_key", "left")
    return both.select("canonical_key", F.array_sort(F.array_union("seen_sources", F.coalesce("_new", F.array().cast("array<string>")))).alias("seen_sources"))


def latest_stored(paths: DataFrame) -> DataFrame:
    """SRC18: paths ``…/<paper>/v<n>.json`` to each paper's highest version; other names are left out."""
    rule = r"([^/]+)/v(\d+)\.json$"
    found = paths.select(F.regexp_extract("path", rule, 1).alias("paper_id"), F.regexp_extract("path", rule, 2).alias("v")).where("paper_id <> ''")
    return found.groupBy("paper_id").agg(F.max(F.col("v").cast("int")).alias("version"))


def queue_tally(records: DataFrame, reason: Column, updated: Column, since: Column, until: Column) -> tuple[DataFrame, DataFrame]:
    """Records of the window that are admitted, and the count of each reason among the others."""
    due = records.where((updated > since) & (updated <= until)).withColumn("reason", reason)
    return due.where("reason IS NULL").drop("reason"), due.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def reset_watermark(stored: DataFrame, source: str, value: Column) -> DataFrame:
    """T4: a rebuild puts a source's watermark anywhere, also back."""
    return stored.withColumn("ts", F.when(F.col("source") == source, value).otherwise(F.col("ts")))


def schema_readable(stored: Column, current: str) -> Column:
    """the same major version, and no newer minor and patch; other strings are refused."""
    part = lambda i: F.try_element_at(F.split(stored, r"\."), F.lit(i)).try_cast("int")
    major, minor, patch = map(int, current.split("."))
    older = (part(2) < minor) | ((part(2) == minor) & (part(3) <= patch))
    return F.coalesce((F.size(F.split(stored, r"\.")) == 3) & (part(1) == major) & older, F.lit(False))


def reembed(rows: DataFrame, done: DataFrame, embed) -> DataFrame:
    """SNK5: rows that ``done`` lacks, with the vector of their text; ``embed`` is a Column function such as an Arrow UDF. A rerun after a loss goes on where it stopped."""
    text = embed_text(F.col("section"), F.col("abstract"), F.col("lexical_terms"), F.col("title"))
    return rows.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti").withColumn("vector", embed(text))
