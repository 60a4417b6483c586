"""Seniority, employment type, work mode, role scope and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import or_null, strip

# Employment types by source, salary units, and words that put a role in or out of scope.
FLAT_EMPLOYMENT = {"full-time": "full-time", "part-time": "part-time", "contract": "contract", "internship": "internship", "temporary": "contract"}
GRAPH_EMPLOYMENT = FLAT_EMPLOYMENT | {"contractor": "contract", "intern": "internship"}
SALARY_UNITS = {"YEAR": "per annum", "MONTH": "per month", "HOUR": "per hour"}
EXCLUDED_ROLES = (
    "bpo", "customer support", "customer service", "voice process", "non-voice", "non voice", "telecaller", "telecalling", "call center", "call centre", "chat support", "back office",
    "sales executive", "sales manager", "sales associate", "sales officer", "business development", "bde", "field sales", "telesales",
    "marketing executive", "marketing manager", "digital marketing", "brand marketing", "content marketing",
    "hr executive", "hr manager", "hr generalist", "human resource", "recruiter", "recruitment", "talent acquisition", "admin executive", "administrative", "office admin", "front office", "receptionist",
)
INCLUDED_ROLES = (
    "software", "developer", "programmer", "sde", "full stack", "fullstack", "front-?end", "back-?end", "devops", "data engineer", "data scientist", "data analyst",
    "machine learning", "ml engineer", "ai engineer", "qa engineer", "sdet", "test engineer", "automation engineer", "cloud engineer", "site reliability", "sre",
    "mobile developer", "android developer", "ios developer", "web developer", "cybersecurity", "security engineer", "database administrator", "dba", "network engineer", "systems engineer",
)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def seniority_of_years(years: Column) -> Column:
    return F.when(years == 0, "fresher").when(years <= 2, "junior").when(years <= 5, "mid").when(years <= 8, "senior").when(years > 8, "lead")


def years_in(text: Column) -> Column:
    """The first integer of a text; one too long to be a number counts as many."""
    digits = or_null(F.regexp_extract(text, r"(?U)\d+", 0))
    return F.when(digits.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(2**31)))


def seniority(text: Column) -> Column:
    return seniority_of_years(years_in(text))


def seniority_or_title(text: Column, months: Column, title: Column) -> Column:
    """From text, or from months, or fresher where the title says so."""
    years = F.coalesce(years_in(text), F.floor(months / 12))
    return F.coalesce(seniority_of_years(years), F.when(F.contains(F.lower(title), F.lit("fresher")), "fresher"))


def employment(raw: Column) -> Column:
    """One value; an unknown one passes in lower case."""
    key = F.lower(strip(or_null(raw)))
    return F.coalesce(F.try_element_at(_map(FLAT_EMPLOYMENT), key), key)


def employment_of_list(raw: Column) -> Column:
    """The first known one of several values."""
    keys = F.transform(F.split(F.coalesce(raw, F.lit("")), "[,/]"), lambda x: F.regexp_replace(F.lower(strip(x)), r"(?U)[\s_]+", "-"))
    found = F.transform(keys, lambda k: F.try_element_at(_map(GRAPH_EMPLOYMENT), k))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def inferred_remote(*texts: Column) -> Column:
    """remote or virtual, unless hybrid, somewhere in the texts."""
    all_ = F.lower(F.concat_ws(" ", *[or_null(t) for t in texts]))
    return ~F.contains(all_, F.lit("hybrid")) & (F.contains(all_, F.lit("remote")) | F.contains(all_, F.lit("virtual")))


def in_scope(title: Column, skills: Column) -> Column:
    """A software role: an included word and no excluded one."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(skills, F.lit("")))
    word = lambda names: rf"(?iU)\b({'|'.join(names)})\b"
    return ~text.rlike(word(EXCLUDED_ROLES)) & text.rlike(word(INCLUDED_ROLES))


def iso_time(text: Column) -> Column:
    """An ISO-8601 date or time, null if it isn't one; without an offset it is UTC. The session's zone must be UTC."""
    shape = r"^\d{4}-?\d{2}-?\d{2}([T ].+)?$"
    dashed = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    clock = F.regexp_replace(dashed, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(\d{2})", "$1:$2:$3")
    return F.when(text.rlike(shape), clock.try_cast("timestamp"))
