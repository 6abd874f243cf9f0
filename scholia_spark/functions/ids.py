"""Identifiers of papers: parsing, canonical keys, fingerprints, priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia_spark.functions.text import normalize_text


def arxiv_ref(raw: Column, default_version: int = 1) -> Column:
    """Struct (paper_id, version) of a reference, address or versioned id; null where it is none."""
    ref = F.trim(raw)
    for pattern in (r"(?i)^(?:https?://)?(?:www\.)?arxiv\.org/(?:abs|pdf)/", r"(?i)^arxiv:", r"(?i)\.pdf$"):
        ref = F.regexp_replace(ref, pattern, "")
    ref = F.regexp_replace(ref, r"^/+|/+$", "")
    base = F.regexp_replace(ref, r"(?i)^(.+?)v[1-9][0-9]*$", "$1")
    version = F.regexp_extract(ref, r"(?i)^.+?v([1-9][0-9]*)$", 1)
    valid = F.regexp_like(base, F.lit(r"(?i)^(?:[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})$"))
    return F.when(valid, F.struct(base.alias("paper_id"), F.when(version == "", default_version).otherwise(version.cast("int")).alias("version")))


def year_of(paper_id: Column) -> Column:
    """20YY of a YYMM id, else null."""
    yy = F.regexp_extract(paper_id, r"^([0-9]{2})[0-9]{2}\.[0-9]{4,5}$", 1)
    return F.when(yy != "", yy.cast("int") + 2000)


def fingerprint(paper_id: Column, version: Column) -> Column:
    """X7."""
    return F.sha2(F.concat(paper_id, F.lit(":v"), version.cast("string")), 256)


def canonical_key(title: Column, year: Column, doi: Column, arxiv_id: Column, first_author: Column) -> Column:
    """By DOI, else arXiv id without version, else a hash of title, first author and year."""
    clean = lambda x: F.lower(normalize_text(F.coalesce(x, F.lit(""))))
    doi_, arxiv = F.lower(F.trim(F.coalesce(doi, F.lit("")))), F.lower(F.trim(F.coalesce(arxiv_id, F.lit(""))))
    named = F.concat_ws("|", clean(title), clean(first_author), year.cast("string"))
    return (
        F.when(doi_ != "", F.concat(F.lit("doi:"), doi_)).when(arxiv != "", F.concat(F.lit("arxiv:"), F.regexp_replace(arxiv, r"v[0-9]+$", "")))
        .otherwise(F.concat(F.lit("title:"), F.substring(F.sha2(named, 256), 1, 24)))
    )


def source_priority(name: Column) -> Column:
    """Lower wins."""
    return F.when(name == "ARXIV", 0).when(name == "SEMANTIC_SCHOLAR", 1).when(name == "OPENALEX", 2).otherwise(9)


def id_key(paper_id: Column) -> Column:
    """X11: lower case, without the namespace and the version."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(paper_id)), "^arxiv:", ""), r"v\d+$", "")


def bare_doi(doi: Column) -> Column:
    """X14."""
    return F.regexp_replace(F.lower(F.trim(doi)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:)", "")


def chunk_id(paper_id: Column, ordinal: Column) -> Column:
    """paper#ordinal; null where the id holds a # or the ordinal is negative."""
    return F.when(~F.contains(paper_id, F.lit("#")) & (ordinal >= 0), F.concat(paper_id, F.lit("#"), ordinal.cast("string")))


def dedupe_key(*parts: Column) -> Column:
    """X22."""
    return F.sha2(F.concat_ws("|", *parts), 256)


#: Tiers of the first source that do not name it.
ARXIV_TIERS = ("native_html", "ar5iv", "eprint_latex", "pdf")


def tier_priority(tier: Column) -> Column:
    """Rank of the source that a stored tier names (smaller is better)."""
    up = F.upper(tier)
    return F.when(F.contains(up, F.lit("ARXIV")) | tier.isin(*ARXIV_TIERS), 0).when(F.contains(up, F.lit("SEMANTIC_SCHOLAR")), 1).otherwise(2)


def namespace(paper_id: Column) -> Column:
    """Namespace of an id outside the corpus, else null."""
    prefix = F.when(F.contains(paper_id, F.lit(":")), F.split_part(paper_id, F.lit(":"), F.lit(1)))
    return F.when(prefix.isin("arxiv", "doi", "userdoc", "attachment"), prefix)


def live_key(arxiv: Column, doi: Column) -> Column:
    """The arXiv id (also one inside its own DOI prefix), else the DOI."""
    low = F.lower(F.trim(F.coalesce(doi, F.lit(""))))
    found = F.coalesce(F.nullif(F.trim(arxiv), F.lit("")), F.when(low.startswith("10.48550/arxiv."), F.substring(low, 16, 1000)))
    return F.when(found.isNotNull(), F.concat(F.lit("arxiv:"), F.regexp_replace(found, r"v\d+$", ""))).otherwise(F.concat(F.lit("doi:"), F.lower(F.coalesce(doi, F.lit("")))))


def record_ref(ref: Column) -> Column:
    """Struct (paper, version) of at most 100 characters, else null."""
    whole = r"(?i)^(?:arxiv:)?(.+?)(?:v(\d+))?$"
    paper = F.regexp_extract(ref, whole, 1)
    return F.when((F.length(ref) <= 100) & (paper != ""), F.struct(paper.alias("paper"), F.nullif(F.regexp_extract(ref, whole, 2), F.lit("")).cast("int").alias("version")))


#: Forms of identifiers, and prefixes that a citation graph knows.
ARXIV_WITH_PREFIX = r"(?i)^(?:arxiv:)?(?:[a-z-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?$"
ARXIV_BARE = r"(?i)^(?:[a-z-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?$"
DOI_BARE = r"(?i)^10\.\d{4,9}/\S+$"
GRAPH_PREFIXES = ("DOI", "PMID", "PMCID", "MAG", "ACL", "CORPUSID", "URL")


def versioned_arxiv(paper_id: Column) -> Column:
    """The arXiv id with its version (1 where it has none), else null."""
    bare = F.trim(paper_id)
    ref = record_ref(bare)
    ok = F.regexp_like(bare, F.lit(ARXIV_WITH_PREFIX))
    return F.when(ok, F.concat(ref["paper"], F.lit("v"), F.coalesce(ref["version"], F.lit(1)).cast("string")))


def graph_paper_id(paper_id: Column) -> Column:
    """The form a citation graph looks papers up by."""
    v = F.trim(paper_id)
    prefix, rest = F.upper(F.regexp_extract(v, "^([^:]*):", 1)), F.regexp_extract(v, "^[^:]*:(.*)$", 1)
    bare = lambda c: F.regexp_replace(c, r"(?i)v\d+$", "")
    return (
        F.when(prefix == "ARXIV", F.concat(F.lit("ARXIV:"), bare(rest)))
        .when(prefix.isin(*GRAPH_PREFIXES), F.concat(prefix, F.lit(":"), rest))
        .when(F.regexp_like(v, F.lit(ARXIV_BARE)), F.concat(F.lit("ARXIV:"), bare(v)))
        .when(F.regexp_like(v, F.lit(DOI_BARE)), F.concat(F.lit("DOI:"), v))
        .when(F.regexp_like(v, F.lit("^https?://")), F.concat(F.lit("URL:"), v)).otherwise(v)
    )


def cache_key(request: Column, glossary_ver: Column, user_id: Column, model_ver: str, prompt_ver: str, format_ver: str, seed_ver: str, parser: str) -> Column:
    """Parts of a cache key. ``request``: paper_id, version, task, lang, scope, persona. Summaries cover the whole paper; translations have no persona; the owner counts only with a glossary."""
    summary = request["task"] == "summary"
    return F.concat_ws(
        "/", request["paper_id"], request["version"].cast("string"), request["task"], request["lang"], F.when(summary, "full").otherwise(request["scope"]), F.when(summary, request["persona"]).otherwise("expert"),
        glossary_ver.cast("string"), F.when(glossary_ver > 0, user_id).otherwise("-"), F.lit(model_ver), F.when(summary, prompt_ver).otherwise(f"{prompt_ver}-{format_ver}"), F.lit(seed_ver), F.lit(parser.rpartition("@")[2]),
    )
