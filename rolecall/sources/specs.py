"""Search definitions: one row per configured search."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rolecall import schemas
from rolecall.functions.matching import checked_keywords
from rolecall.functions.text import search_expression

DEFAULT_INTERVAL = 60
DEFAULT_MAX_RESULTS = 100
DEFAULT_TTL_SECONDS = 5 * 86400

#: Search type to the ``source`` its postings carry, and whether the search
#: checks its keywords against the description (the other kind of site has
#: already searched, and its cards hold no description).
SOURCES = {"linkedin": ("linkedin", True), "startups": ("startups", False)}


@dataclass(frozen=True)
class SearchSpec:
    name: str
    type: str
    interval: int = DEFAULT_INTERVAL
    enabled: bool = True
    message: str | None = None
    keywords: tuple[str, ...] = ()
    location: str | None = None
    job_type: str | None = None
    workplace_type: str | None = None
    experience_level: str | None = None
    last_time_posted: int | None = None
    excluded_companies: tuple[str, ...] = ()
    max_results: int = DEFAULT_MAX_RESULTS
    ttl_seconds: int = DEFAULT_TTL_SECONDS

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a search needs a name")
        if not self.type:
            raise ValueError(f"search {self.name!r} needs a type")
        if self.interval <= 0:
            raise ValueError(f"the interval of {self.name!r} must be positive, got {self.interval}")
        if self.ttl_seconds <= 0:
            raise ValueError(f"ttl_seconds of {self.name!r} must be positive")
        object.__setattr__(self, "type", self.type.lower())
        if isinstance(self.keywords, str):
            object.__setattr__(self, "keywords", (self.keywords,))
        object.__setattr__(self, "keywords", tuple(checked_keywords(self.keywords or ())))
        object.__setattr__(self, "excluded_companies", tuple(self.excluded_companies or ()))

    @classmethod
    def from_dict(cls, data: dict) -> "SearchSpec":
        """From ``{name, type, interval, enabled, message, config: {...}}``; what
        ``config`` holds beyond the fields here is ignored."""
        config = data.get("config") or {}
        known = {k: config[k] for k in (
            "keywords", "location", "job_type", "workplace_type", "experience_level",
            "last_time_posted", "excluded_companies", "max_results", "ttl_seconds",
        ) if config.get(k) is not None}
        return cls(
            name=data.get("name", ""), type=data.get("type", ""),
            interval=data.get("interval", DEFAULT_INTERVAL),
            enabled=data.get("enabled", True), message=data.get("message"), **known)


def specs_from_config(config: dict) -> list[SearchSpec]:
    """All searches of a configuration with a ``workers`` list."""
    specs = [SearchSpec.from_dict(entry) for entry in config.get("workers") or []]
    return check_types(specs)


def check_types(specs: list[SearchSpec]) -> list[SearchSpec]:
    for spec in specs:
        if spec.type not in SOURCES:
            raise ValueError(f"unknown search type {spec.type!r}; known: {', '.join(SOURCES)}")
    return specs


def register_search_type(name: str, source: str, checks_keywords: bool = True) -> None:
    SOURCES[name.lower()] = (source, checks_keywords)


def enabled(specs: list[SearchSpec]) -> list[SearchSpec]:
    return [spec for spec in specs if spec.enabled]


def by_name(specs: list[SearchSpec], name: str) -> SearchSpec | None:
    return next((spec for spec in specs if spec.name == name), None)


def specs_frame(spark: SparkSession, specs: list[SearchSpec]) -> DataFrame:
    """The searches as a table."""
    names = schemas.SEARCH_SPECS.fieldNames()
    rows = [tuple(list(v) if isinstance(v := asdict(s)[n], tuple) else v for n in names)
            for s in specs]
    return spark.createDataFrame(rows, schemas.SEARCH_SPECS)


def read_specs(spark: SparkSession, path: str) -> list[SearchSpec]:
    """Searches from a JSON-lines table. A configuration is small by nature; the
    rows are read one by one all the same."""
    table = spark.read.schema(schemas.SEARCH_SPECS).json(path)
    rows = (row.asDict() for row in table.toLocalIterator())
    return check_types([
        SearchSpec(**{k: v for k, v in row.items() if v is not None}) for row in rows])


def with_expression(specs: DataFrame) -> DataFrame:
    """Adds the search as the text a site would be asked."""
    return specs.withColumn("expression", search_expression(
        F.col("keywords"), F.col("excluded_companies")))
