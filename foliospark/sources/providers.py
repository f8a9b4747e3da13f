"""Providers and their field maps as data, and resolving them by URL or name."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.scalars import normalize_name, normalize_url
from foliospark.operators.fieldmap import AcademicMap

DEFAULT_DELAY, DEFAULT_PAGE_SIZE = 6.1, 25


@dataclass(frozen=True)
class Provider:
    """Where a provider is, what its parameters are called, and where its page counts stand."""

    name: str
    base_url: str
    query: str
    start: str | None
    page_size: str
    zero_indexed: bool = False
    auto_calculate: bool = True
    records_per_page: int = DEFAULT_PAGE_SIZE
    delay: float = DEFAULT_DELAY
    key_required: bool = False
    hits: str | None = None
    size: str | None = None
    extra: dict = field(default_factory=dict)


# The bundled providers.
PROVIDERS = (
    Provider("arxiv", "https://export.arxiv.org/api/query/", "search_query", "start", "max_results", True, True, 25, 4.0, False, "opensearch:totalResults", "opensearch:itemsPerPage"),
    Provider("core", "https://api.core.ac.uk/v3/search/works", "q", "offset", "limit", False, True, 25, DEFAULT_DELAY, False, "totalHits", "limit"),
    Provider("crossref", "https://api.crossref.org/works", "query", "offset", "rows", False, True, 25, 1.0, False, "total-results", "items-per-page"),
    Provider("openalex", "https://api.openalex.org/works", "search", "page", "per_page", False, False, 25, DEFAULT_DELAY, False, "count", "per_page"),
    Provider("plos", "https://api.plos.org/search", "q", "start", "rows", False, True, 50, DEFAULT_DELAY, False, "numFound", None),
    Provider("pubmed", "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", "term", "retstart", "retmax", False, True, 20, 2.0, True, "Count", "RetMax", {"db": "pubmed", "use_history": "y"}),
    Provider("pubmedefetch", "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi", "term", None, "retmax", False, False, 20, 2.0, True, "Count", "RetMax", {"db": "pubmed", "retmode": "xml"}),
    Provider("springernature", "https://api.springernature.com/meta/v2/json", "q", "s", "p", False, True, 25, DEFAULT_DELAY, True, "total", "pageLength"),
)

_ARTICLE = "MedlineCitation.Article"

# Where each provider keeps the fields of the shared schema.
FIELD_MAPS = {
    "arxiv": AcademicMap(
        "arxiv",
        {"doi": "arxiv:doi", "url": "id", "record_id": "id", "title": "title", "abstract": "summary", "authors": "author.name", "journal": "arxiv:journal_ref", "year": "published", "date_published": "published", "date_created": "published", "subjects": "arxiv:primary_category.@term", "license": "rights"},
        {"primary_category": "arxiv:primary_category.@term", "updated_date": "updated", "pdf_url": "link.@href"},
    ),
    "core": AcademicMap(
        "core",
        {"doi": "doi", "url": "downloadUrl", "record_id": "id", "title": "title", "abstract": "abstract", "authors": "authors.name", "journal": "journals", "publisher": "publisher", "year": "yearPublished", "date_published": "publishedDate", "date_created": "createdDate", "keywords": "subjects", "subjects": "subjects", "full_text": "fullText", "citation_count": "citationCount", "record_type": "documentType", "language": "language.name"},
        {},
        {"open_access": "true"},
    ),
    "crossref": AcademicMap(
        "crossref",
        {"doi": "DOI", "url": "URL", "record_id": "DOI", "title": "title", "abstract": "abstract", "authors": "author.name", "journal": "container-title", "publisher": "publisher", "year": "published.date-parts", "date_published": "published.date-parts", "date_created": "created.date-time", "keywords": "subject", "subjects": "subject", "citation_count": "is-referenced-by-count", "license": "license.URL", "record_type": "type", "language": "language"},
        {"issn": "ISSN", "isbn": "ISBN", "volume": "volume", "issue": "issue", "page": "page", "references_count": "reference-count", "funder": "funder.name"},
    ),
    "openalex": AcademicMap(
        "openalex",
        {"doi": "doi", "url": "primary_location.landing_page_url", "record_id": "id", "title": "title", "authors": "authorships.author.display_name", "journal": "primary_location.source.display_name", "publisher": "primary_location.source.host_organization_name", "year": "publication_year", "date_published": "publication_date", "date_created": "created_date", "keywords": "keywords.display_name", "subjects": "topics.display_name", "citation_count": "cited_by_count", "open_access": "open_access.is_oa", "license": "primary_location.license", "record_type": "type", "language": "language"},
        {"oa_status": "open_access.oa_status", "cited_by_api_url": "cited_by_api_url", "references_count": "referenced_works_count", "affiliations": "authorships.institutions.display_name", "fields": "topics.field.display_name", "sdgs": "sustainable_development_goals.display_name"},
    ),
    "plos": AcademicMap(
        "plos",
        {"doi": "id", "record_id": "id", "title": "title_display", "abstract": "abstract", "authors": "author_display", "journal": "journal", "year": "publication_date", "date_published": "publication_date", "date_created": "publication_date", "keywords": "subject", "subjects": "article_type", "record_type": "article_type"},
        {"issn": "eissn", "page": "page_number", "score": "score", "volume": "volume", "issue": "issue", "page_range": "elocation_id", "cross_published_journal": "cross_published_journal_name"},
        {"publisher": "Public Library of Science", "open_access": "true"},
    ),
    "pubmed": AcademicMap(
        "pubmed",
        {"doi": f"{_ARTICLE}.ELocationID.#text", "record_id": "MedlineCitation.PMID.#text", "title": [f"{_ARTICLE}.ArticleTitle.#text", f"{_ARTICLE}.ArticleTitle"], "abstract": [f"{_ARTICLE}.Abstract.AbstractText.#text", f"{_ARTICLE}.Abstract.AbstractText"], "authors": f"{_ARTICLE}.AuthorList.Author.LastName", "journal": f"{_ARTICLE}.Journal.Title", "year": f"{_ARTICLE}.Journal.JournalIssue.PubDate.Year", "date_published": f"{_ARTICLE}.Journal.JournalIssue.PubDate.Year", "date_created": "MedlineCitation.DateCompleted.Year", "keywords": "MedlineCitation.KeywordList.Keyword.#text", "subjects": "MedlineCitation.MeshHeadingList.MeshHeading.DescriptorName.#text", "license": f"{_ARTICLE}.Abstract.CopyrightInformation", "record_type": f"{_ARTICLE}.PublicationTypeList.PublicationType.#text", "language": f"{_ARTICLE}.Language"},
        {"pmid": "MedlineCitation.PMID.#text", "pmcid": "PubmedData.ArticleIdList.ArticleId.#text", "pii": "PubmedData.ArticleIdList.ArticleId.#text", "mesh_terms": "MedlineCitation.MeshHeadingList.MeshHeading.DescriptorName.#text", "mesh_qualifiers": "MedlineCitation.MeshHeadingList.MeshHeading.QualifierName.#text", "mesh_ui": "MedlineCitation.MeshHeadingList.MeshHeading.DescriptorName.@UI", "issn": f"{_ARTICLE}.Journal.ISSN.#text", "iso_abbreviation": f"{_ARTICLE}.Journal.ISOAbbreviation", "volume": f"{_ARTICLE}.Journal.JournalIssue.Volume", "issue": f"{_ARTICLE}.Journal.JournalIssue.Issue", "pages": f"{_ARTICLE}.Pagination.MedlinePgn", "start_page": f"{_ARTICLE}.Pagination.StartPage", "end_page": f"{_ARTICLE}.Pagination.EndPage"},
    ),
    "springernature": AcademicMap(
        "springernature",
        {"doi": "doi", "url": "url", "record_id": "identifier", "title": "title", "abstract": "abstract", "authors": "creators.creator", "journal": "publicationName", "publisher": "publisher", "year": "publicationDate", "date_published": "publicationDate", "date_created": "onlineDate", "keywords": "keyword", "subjects": "subjects", "open_access": "openaccess", "license": "copyright", "record_type": "contentType", "language": "language"},
        {"isbn": "isbn", "issn": "issn", "eisbn": "eisbn", "eissn": "eIssn", "journal_id": "journalId", "volume": "volume", "issue": "number", "start_page": "startingPage", "end_page": "endingPage", "article_type": "genre"},
    ),
}
FIELD_MAPS["pubmedefetch"] = FIELD_MAPS["pubmed"].renamed("pubmed_efetch")


class Registry:
    """Providers by normalised name; more can be added."""

    def __init__(self, providers: tuple[Provider, ...] = PROVIDERS, maps: dict[str, AcademicMap] | None = None) -> None:
        self.providers = {self.key(p.name): p for p in providers}
        self.maps = dict(FIELD_MAPS if maps is None else maps)

    @staticmethod
    def key(name: str) -> str:
        return name.lower().replace("_", "").strip()

    def add(self, provider: Provider, field_map: AcademicMap | None = None) -> None:
        self.providers[self.key(provider.name)] = provider
        if field_map:
            self.maps[self.key(provider.name)] = field_map

    def get(self, name: str) -> Provider:
        return self.providers[self.key(name)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The provider dimension; small by construction (one row for each configured provider)."""
        rows = [(k, p.base_url, p.query, p.start, p.page_size, p.zero_indexed, p.auto_calculate, p.records_per_page, p.delay, p.key_required, p.hits, p.size) for k, p in self.providers.items()]
        return spark.createDataFrame(rows, "provider string, base_url string, query_param string, start_param string, size_param string, zero_indexed boolean, auto_calculate boolean, records_per_page int, delay double, key_required boolean, hits_path string, size_path string")

    def resolve(self, frame: DataFrame, url: Column, name: Column) -> DataFrame:
        """Adds ``provider``: by URL (normalised, without parameters), else by name."""
        known = self.frame(frame.sparkSession).select("provider", normalize_url(F.col("base_url"), keep_parameters=False).alias("_base"))
        by_url = F.broadcast(known.select(F.col("provider").alias("_by_url"), "_base"))
        by_name = F.broadcast(known.select(F.col("provider").alias("_by_name")))
        found = frame.withColumn("_u", normalize_url(url, keep_parameters=False)).withColumn("_n", normalize_name(name))
        found = found.join(by_url, F.col("_u") == F.col("_base"), "left").join(by_name, F.col("_n") == F.col("_by_name"), "left")
        return found.withColumn("provider", F.coalesce("_by_url", "_by_name")).drop("_u", "_n", "_base", "_by_url", "_by_name")

    def relabelled(self, pages: DataFrame, url: str = "url", name: str = "provider_name") -> DataFrame:
        """Pages of a plan of several steps under the provider that their last URL belongs to; the given name stays where none is known."""
        by_url = self.resolve(pages.withColumn("_given", F.col(name)), F.col(url), F.lit(None).cast("string"))
        return by_url.select(*(F.coalesce("provider", "_given").alias(name) if c == name else F.col(c) for c in pages.columns))


def request_parameters(provider: Provider, query: Column, page: Column, page_size: Column | None = None, **specific: Column) -> Column:
    """The provider's own parameters as a map, without nulls; the core ones cannot be overridden."""
    from foliospark.functions.scalars import start_index

    size = page_size if page_size is not None else F.lit(provider.records_per_page)
    start = start_index(page, size, zero_indexed=provider.zero_indexed, auto_calculate=provider.auto_calculate)
    core = {provider.query: query, provider.start: start, provider.page_size: size}
    every = {k: F.lit(v) for k, v in provider.extra.items()} | specific | {k: v for k, v in core.items() if k}
    entries = reduce(lambda a, kv: [*a, F.lit(kv[0]), kv[1].cast("string")], every.items(), [])
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def request_url(provider: Provider, parameters: Column) -> Column:
    """The URL that a request would have, without sending it."""
    listed = F.transform(F.map_entries(parameters), lambda e: F.concat_ws("=", F.url_encode(e["key"]), F.url_encode(e["value"])))
    return F.concat(F.lit(provider.base_url), F.lit("?"), F.array_join(listed, "&"))
