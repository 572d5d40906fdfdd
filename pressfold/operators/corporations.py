"""Companies: lists, search, one company, its industries; changes as new snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressfold.operators.listing import check_page, page_numbers
from pressfold.operators.predicates import active, by_ids, name_match, search_text
from pressfold.schemas import CORPORATION, CORPORATION_INDUSTRY, LIMITS

LINKS = ("home_link", "blog_link", "crew_link", "logo_url")


class NotFound(LookupError):
    """There is no such active company."""


class Conflict(ValueError):
    """An active company has that name already."""


class Invalid(ValueError):
    """Fields with what is wrong about them; of several faults of a field the last counts."""

    def __init__(self, errors: dict[str, str]) -> None:
        super().__init__(str(errors))
        self.errors = errors


@dataclass
class CompanyForm:
    """What a caller may set of a company."""

    name: str | None
    home_link: str | None = None
    blog_link: str | None = None
    crew_link: str | None = None
    logo_url: str | None = None
    industry_ids: list[int] | None = field(default_factory=list)

    def check(self) -> None:
        errors = {}
        if len(self.name or "") > LIMITS["corporation.name"]:
            errors["name"] = f"at most {LIMITS['corporation.name']} characters"
        if not (self.name or "").strip():
            errors["name"] = "must not be blank"
        if errors:
            raise Invalid(errors)


def find_active(corporations: DataFrame, company: int) -> DataFrame:
    return corporations.where((F.col("id") == company) & active())


def name_taken(corporations: DataFrame, name: str) -> bool:
    return not corporations.where((F.col("name") == name) & active()).limit(1).isEmpty()


def with_industries(corporations: DataFrame, links: DataFrame, industries: DataFrame) -> DataFrame:
    """Companies with the sorted names of their industries, an empty array if they have none."""
    names = links.join(industries.select(F.col("id").alias("industry_id"), F.col("name").alias("industry")), "industry_id")
    own = names.groupBy(F.col("corporation_id").alias("id")).agg(F.array_sort(F.collect_list("industry")).alias("industries"))
    return corporations.join(own, "id", "left").withColumn("industries", F.coalesce("industries", F.array().cast("array<string>")))


def company_page(corporations: DataFrame, links: DataFrame, industries: DataFrame, *, search: str | None = None, page: int = 0, size: int = 10) -> DataFrame:
    """A page of active companies, newest first, by name if a search is given."""
    check_page(page, size)
    rows = corporations.where(active())
    wanted = search_text(search)
    if wanted:
        rows = rows.where(name_match(wanted))
    order = [F.desc("created_at"), F.desc("id")]
    best = rows.orderBy(*order).offset(page * size).limit(size)
    own = links.join(best.select(F.col("id").alias("corporation_id")), "corporation_id", "left_semi")
    return with_industries(best, own, industries).orderBy(*order).select("id", "name", *LINKS, "industries", "created_at", "updated_at")


def page_of(corporations: DataFrame, links: DataFrame, industries: DataFrame, *, search: str | None = None, page: int = 0, size: int = 10) -> dict:
    """The list or search as a caller sees it: the rows of a page and its numbers."""
    content = [r.asDict() for r in company_page(corporations, links, industries, search=search, page=page, size=size).collect()]  # one page
    rows, wanted = corporations.where(active()), search_text(search)
    total = (rows.where(name_match(wanted)) if wanted else rows).count()
    return {"content": content, **asdict(page_numbers(total, page, size))}


#: Statuses of what a caller may do with companies.
DONE = {"GET": 200, "POST": 201, "PUT": 200, "DELETE": 200}


def answered(method: str, call: Callable[[], object]) -> tuple[int, object]:
    """(status, body) of a call: 404 for what a GET does not find, 400 for other faults, with the fields or the message."""
    try:
        return DONE[method], call()
    except Invalid as wrong:
        return 400, wrong.errors
    except NotFound as wrong:
        return (404, None) if method == "GET" else (400, {"message": f"company {wrong} not found"})
    except ValueError as wrong:
        return 400, {"message": str(wrong)}


def _next_id(rows: DataFrame) -> int:
    return (rows.agg(F.max("id")).first()[0] or 0) + 1


def linked(links: DataFrame, industries: DataFrame, company: int, wanted: list[int] | None, now: datetime) -> DataFrame:
    """The bridge with this company's rows replaced; unknown industries are ignored, none clears them."""
    kept = links.where(F.col("corporation_id") != company)
    known = sorted(r[0] for r in by_ids(industries, list(wanted or [])).select("id").distinct().collect())
    first = _next_id(links)
    rows = [(first + k, company, industry, now) for k, industry in enumerate(known)]
    return kept.unionByName(links.sparkSession.createDataFrame(rows, CORPORATION_INDUSTRY))


def create(corporations: DataFrame, links: DataFrame, industries: DataFrame, form: CompanyForm, now: datetime) -> tuple[int, DataFrame, DataFrame]:
    """The new id, and the snapshots of companies and bridge that hold it."""
    form.check()
    if name_taken(corporations, form.name):
        raise Conflict(form.name)
    company = _next_id(corporations)
    row = (company, form.name, form.home_link, form.blog_link, form.crew_link, form.logo_url, now, now, None)
    added = corporations.sparkSession.createDataFrame([row], CORPORATION)
    return company, corporations.unionByName(added), linked(links, industries, company, form.industry_ids, now)


def update(corporations: DataFrame, links: DataFrame, industries: DataFrame, company: int, form: CompanyForm, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Snapshots with all fields of the company overwritten, nulls too."""
    form.check()
    old = find_active(corporations, company).select("name").first()
    if old is None:
        raise NotFound(company)
    if old[0] != form.name and name_taken(corporations, form.name):
        raise Conflict(form.name)
    mine = F.col("id") == company
    new = {"name": form.name, **{c: getattr(form, c) for c in LINKS}}
    changed = {c: F.when(mine, F.lit(v).cast("string")).otherwise(F.col(c)) for c, v in new.items()}
    changed["updated_at"] = F.when(mine, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at"))
    return corporations.withColumns(changed), linked(links, industries, company, form.industry_ids, now)


def soft_delete(corporations: DataFrame, company: int, now: datetime) -> DataFrame:
    """The snapshot with the company marked as deleted; its articles stay. A second time it is not found."""
    if find_active(corporations, company).isEmpty():
        raise NotFound(company)
    mine = (F.col("id") == company) & active()
    stamp = F.lit(now).cast("timestamp_ntz")
    return corporations.withColumns({c: F.when(mine, stamp).otherwise(F.col(c)) for c in ("deleted_at", "updated_at")})


def get(corporations: DataFrame, links: DataFrame, industries: DataFrame, company: int) -> dict:
    """An active company with its industries, as a caller sees it."""
    own = links.where(F.col("corporation_id") == company)
    row = with_industries(find_active(corporations, company), own, industries).select("id", "name", *LINKS, "industries", "created_at", "updated_at").first()
    if row is None:
        raise NotFound(company)
    return row.asDict()


def edit_form(corporations: DataFrame, company: int) -> CompanyForm:
    """The fields of an active company for a change; its industries are not among them, so saving clears them."""
    row = find_active(corporations, company).select("name", *LINKS).first()
    if row is None:
        raise NotFound(company)
    return CompanyForm(**row.asDict(), industry_ids=[])
