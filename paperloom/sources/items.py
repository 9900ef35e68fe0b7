"""Recorded replies of bibliographic services as records.

Each parser takes a table with the raw text of one item or page, and the topic and query it was retrieved for, and gives the
columns of :data:`paperloom.schema.RECORD` but ``seq``.  Schemas are declared; blank titles are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import RECORD

_NAME = "struct<name:string>"
OPENALEX = (
    "struct<id:string,title:string,publication_year:int,doi:string,cited_by_count:bigint,ids:struct<arxiv:string>,"
    "authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string>>,"
    "best_oa_location:struct<pdf_url:string>,abstract_inverted_index:map<string,array<int>>>"
)
CORE = (
    f"struct<id:string,title:string,yearPublished:int,doi:string,arxivId:string,citationCount:bigint,abstract:string,publisher:string,"
    f"authors:array<{_NAME}>,journals:array<struct<title:string>>,downloadUrl:string,sourceFulltextUrls:array<string>>"
)
S2 = f"struct<title:string,year:int,citationCount:bigint,abstract:string,url:string,externalIds:struct<DOI:string,ArXiv:string>,authors:array<{_NAME}>>"
ATOM = (
    "struct<title:string,published:string,summary:string,id:string,author:array<struct<name:string>>,"
    "link:array<struct<_title:string,_href:string>>>"
)


def _record(df: DataFrame, source: str, columns: dict[str, Column], query: Column | None = None) -> DataFrame:
    """All record columns, those of ``columns`` set; blank titles dropped."""
    columns = columns | {
        "sources": F.array(F.lit(source)),
        "topic_queries": F.array("topic"),
        "generated_queries": F.array(F.col("query") if query is None else query),
    }
    out = []
    for f in RECORD:
        if f.name == "seq":
            continue
        default = {"citation_count": 0, "influential_citation_count": 0, "background_citation_count": 0, "canonical_score": 0.0, "from_top_survey": False}.get(f.name)
        out.append(F.coalesce(columns.get(f.name, F.lit(None)).cast(f.dataType), F.lit(default).cast(f.dataType)).alias(f.name))
    return df.select(*out).where(F.col("title") != "")


def abstract_of(index: Column) -> Column:
    """The words of an inverted index (word → positions) in order; of words at one place the last counts; gaps vanish."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    numbered = F.transform(placed, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w")))
    ordered = F.sort_array(numbered)
    # bound as a variable, so that it is sorted once and not for each of its elements
    kept = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["p"], F.lit(-1)) != x["p"])
    joined = F.get(F.transform(F.array(ordered), lambda s: F.array_join(F.transform(kept(s), lambda x: x["w"]), " ")), F.lit(0))
    return F.when(F.size(index) > 0, joined)


def _names(a: Column, field: str = "name") -> Column:
    return F.filter(F.transform(a, lambda x: F.trim(x[field])), lambda x: x.isNotNull() & (x != ""))


def openalex(df: DataFrame, raw: str = "raw") -> DataFrame:
    x = df.select("topic", "query", F.from_json(raw, OPENALEX).alias("x"))
    return _record(
        x,
        "openalex",
        {
            "title": F.trim("x.title"),
            "year": F.col("x.publication_year"),
            "authors": F.filter(F.transform("x.authorships", lambda a: F.trim(a["author"]["display_name"])), lambda n: n.isNotNull() & (n != "")),
            "venue": F.col("x.primary_location.source.display_name"),
            "abstract": abstract_of(F.col("x.abstract_inverted_index")),
            "doi": text.doi(F.trim("x.doi")),
            "arxiv_id": text.arxiv_id(F.regexp_replace("x.ids.arxiv", "/+$", "")),
            "url": F.when(F.col("x.id") != "", F.col("x.id")),
            "pdf_url": F.col("x.best_oa_location.pdf_url"),
            "citation_count": F.col("x.cited_by_count"),
        },
    )


def core(df: DataFrame, year_from: int, year_to: int, raw: str = "raw") -> DataFrame:
    """Years outside the range go; unknown ones stay."""
    x = df.select("topic", "query", F.from_json(raw, CORE).alias("x"))
    journal = F.get("x.journals", F.lit(0))["title"]
    rows = _record(
        x,
        "core",
        {
            "title": F.trim("x.title"),
            "year": F.col("x.yearPublished"),
            "authors": F.array_distinct(_names(F.col("x.authors"))),
            "venue": F.coalesce(F.when(journal != "", F.trim(journal)), F.when(F.col("x.publisher") != "", F.trim("x.publisher"))),
            "abstract": F.replace(F.when(F.trim("x.abstract") != "", F.trim("x.abstract")), F.lit("\n"), F.lit(" ")),
            "doi": text.doi(F.trim("x.doi")),
            "arxiv_id": F.when(F.col("x.arxivId") != "", F.split_part("x.arxivId", F.lit("v"), F.lit(1))),
            "url": F.when(F.col("x.id") != "", F.concat(F.lit("https://core.ac.uk/works/"), "x.id")),
            "pdf_url": F.coalesce(F.when(F.col("x.downloadUrl") != "", F.col("x.downloadUrl")), F.get("x.sourceFulltextUrls", F.lit(0))),
            "citation_count": F.col("x.citationCount"),
        },
    )
    return rows.where(F.col("year").isNull() | F.col("year").between(year_from, year_to))


def arxiv(df: DataFrame, year_from: int, year_to: int, raw: str = "raw") -> DataFrame:
    """``raw`` is one Atom entry; for whole pages use :func:`atom_entries` first."""
    x = df.select("topic", "query", F.from_xml(F.col(raw), ATOM).alias("x"))
    line = lambda c: F.replace(F.trim(c), F.lit("\n"), F.lit(" "))
    rows = _record(
        x,
        "arxiv",
        {
            "title": line("x.title"),
            "year": F.substring("x.published", 1, 4).try_cast("int"),
            "authors": _names(F.col("x.author")),
            "venue": F.lit("arXiv"),
            "abstract": line("x.summary"),
            "arxiv_id": text.arxiv_id(F.trim("x.id")),
            "url": F.when(F.trim("x.id") != "", F.trim("x.id")),
            "pdf_url": F.get(F.filter("x.link", lambda v: v["_title"] == "pdf"), F.lit(0))["_href"],
        },
    )
    return rows.where(F.col("year").isNull() | F.col("year").between(year_from, year_to))


def atom_entries(pages: DataFrame, page: str = "page") -> DataFrame:
    """One row (raw) for each entry of an Atom page."""
    return pages.select("topic", "query", F.explode(F.regexp_extract_all(page, F.lit(r"(?s)(<entry\b.*?</entry>)"), F.lit(1))).alias("raw"))


def semantic_scholar(df: DataFrame, raw: str = "raw") -> DataFrame:
    x = df.select("topic", "query", F.from_json(raw, S2).alias("x"))
    doi, ax = F.col("x.externalIds.DOI"), F.col("x.externalIds.ArXiv")
    url = F.coalesce(F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)), F.when(ax != "", F.concat(F.lit("https://arxiv.org/abs/"), ax)), F.when(F.col("x.url") != "", F.col("x.url")))
    columns = {
        "title": F.trim("x.title"), "year": F.col("x.year"), "authors": _names(F.col("x.authors")), "abstract": F.col("x.abstract"), "doi": doi,
        "arxiv_id": ax, "url": url, "citation_count": F.col("x.citationCount"),
    }
    return _record(x, "semanticscholar", columns, F.concat(F.lit("top-cited-survey(s2): "), "query"))


# Hosts that refuse automated access.
BLOCKED = (
    "ieeexplore.ieee.org", "dl.acm.org", "onlinelibrary.wiley.com", "link.springer.com", "sciencedirect.com", "tandfonline.com",
    "journals.sagepub.com",
)


def pdf_address(arxiv_id: str, stored: str, by_doi: str, by_title: str) -> Column:
    """The first address that may be fetched: arXiv, the stored one, looked up by DOI, by title; blocked hosts only through arXiv."""
    ok = lambda c: F.when((F.col(c) != "") & ~text.any_term(F.lower(c), BLOCKED), F.col(c))
    return F.coalesce(F.when(F.col(arxiv_id) != "", F.concat(F.lit("https://arxiv.org/pdf/"), F.col(arxiv_id))), ok(stored), ok(by_doi), ok(by_title))
