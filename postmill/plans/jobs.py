"""Filtered, sorted and paged reads of the jobs table."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import ilike_any, or_else, or_null
from postmill.schema import PUBLIC


@dataclass(frozen=True)
class JobQuery:
    """A blank text is unset; false is a filter of its own."""

    source: str | None = None
    location: str | None = None
    employment_type: str | None = None
    seniority: str | None = None
    is_remote: bool | None = None
    has_salary: bool | None = None
    min_salary: int | None = None
    tag: str | None = None
    q: str | None = None
    include_inactive: bool = False
    sort: str = "posted_at"
    order: str = "desc"
    limit: int = 20
    offset: int = 0

    def __post_init__(self):
        if self.sort not in ("posted_at", "scraped_at"):
            raise ValueError(f"sort: {self.sort}")
        if self.order not in ("asc", "desc"):
            raise ValueError(f"order: {self.order}")
        if not 1 <= self.limit <= 100:
            raise ValueError(f"limit: {self.limit}")
        if self.offset < 0:
            raise ValueError(f"offset: {self.offset}")

    @staticmethod
    def from_params(params: dict[str, object]) -> JobQuery:
        """Of request parameters: the first of repeated ones, blank ones unset, booleans only where ``true``."""
        found: dict[str, object] = {}
        for f in fields(JobQuery):
            v = params.get(f.name)
            v = v[0] if isinstance(v, list | tuple) and v else None if isinstance(v, list | tuple) else v
            if v is None or v == "":
                continue
            if f.name in ("is_remote", "has_salary", "include_inactive"):
                if str(v).lower() == "true":
                    found[f.name] = True
            elif f.name in ("min_salary", "limit", "offset"):
                found[f.name] = max(0, int(str(v))) if f.name == "offset" else int(str(v))
            else:
                found[f.name] = str(v)
        return JobQuery(**found)

    def predicates(self) -> list[Column]:
        out = [] if self.include_inactive else [F.col("is_active")]
        out += [F.col(k) == v for k in ("source", "employment_type", "seniority") if (v := getattr(self, k))]
        out += [F.col(k) == v for k in ("is_remote", "has_salary") if (v := getattr(self, k)) is not None]
        if self.location:
            out.append(ilike_any(F.col("location"), self.location))
        if self.min_salary is not None:
            out.append(F.col("salary_min").isNotNull() & (F.col("salary_min") >= self.min_salary))
        if self.tag:
            out.append(F.coalesce(F.array_contains("tags", self.tag), F.lit(False)))
        if self.q:
            out.append(ilike_any(F.col("title"), self.q) | ilike_any(F.col("company"), self.q))
        return out


def matching(jobs: DataFrame, query: JobQuery) -> DataFrame:
    for p in query.predicates():
        jobs = jobs.where(p)
    return jobs


def ordered(jobs: DataFrame, column: str, order: str, tie: str = "id") -> DataFrame:
    """Newest first with undated last, or oldest first with undated first; ties by id."""
    key = F.col(column).desc_nulls_last() if order == "desc" else F.col(column).asc_nulls_first()
    return jobs.orderBy(key, F.col(tie).asc())


def public(jobs: DataFrame) -> DataFrame:
    """The public projection: a rewritten description before the original one, a resolved link before the raw one."""
    shown = jobs.withColumns(
        {
            "description": F.coalesce(or_null(F.col("rewritten_description")), F.col("description_original")),
            "is_rewritten": F.col("rewritten_description").isNotNull(),
            "apply_url": or_else(F.col("apply_url"), F.col("raw_apply_url")),
        }
    )
    return shown.select(*PUBLIC)


def page(jobs: DataFrame, query: JobQuery) -> DataFrame:
    """One page: a bounded sort of limit + offset rows, no full one."""
    return public(ordered(matching(jobs, query), query.sort, query.order).offset(query.offset).limit(query.limit))


def total(jobs: DataFrame, query: JobQuery) -> DataFrame:
    return matching(jobs, query).agg(F.count("*").alias("total"))


def listing(jobs: DataFrame, query: JobQuery) -> dict:
    """The envelope: items, total, limit, offset."""
    return {"items": page(jobs, query).collect(), "total": total(jobs, query).first().total, "limit": query.limit, "offset": query.offset}


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each row, nulls included, as a response's items."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def get(jobs: DataFrame, job_id: str):
    """The row of this id, or None."""
    return public(jobs.where(F.col("id") == job_id)).limit(1).first()


def similar(jobs: DataFrame, job_id: str, most: int = 5, shown: int = 4) -> DataFrame:
    """Jobs with the same first tag, else the same seniority: the newest five, less the job itself, at most four."""
    job = jobs.where(F.col("id") == job_id).select("tags", "seniority").first()
    if job is None:
        return public(jobs.limit(0))
    query = JobQuery(tag=job.tags[0], limit=most) if job.tags else JobQuery(seniority=job.seniority, limit=most)
    return page(jobs, query).where(F.col("id") != job_id).limit(shown)


def similar_all(jobs: DataFrame, key: str, order: list[Column], id_col: str = "id", most: int = 5, shown: int = 4) -> DataFrame:
    """The same for all rows at once, over one key: ranks each key's first few before the join."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order, id_col))
    top = jobs.withColumn("rank", rank).where(F.col("rank") <= most).select(F.col(key).alias("__k"), F.col(id_col).alias("similar_id"), "rank")
    # A key's few go into one row, so that the join has a row for each job and key.
    few = top.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("rank", "similar_id"))).alias("few"))
    rows = jobs.select(F.col(id_col), F.col(key).alias("__k")).join(few, "__k")
    kept = F.slice(F.filter("few", lambda x: x["similar_id"] != F.col(id_col)), F.lit(1), F.lit(shown))
    return rows.select(id_col, F.posexplode(F.transform(kept, lambda x: x["similar_id"])).alias("position", "similar_id"))
