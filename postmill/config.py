"""Settings, from the environment where it names them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    max_job_age_hours: int = 24
    flat_max_pages: int = 500
    graph_max_pages: int = 400
    flat_crawl_delay_seconds: float = 1.0
    graph_crawl_delay_seconds: float = 1.5
    resolver_max_hops: int = 3
    resolver_timeout_seconds: float = 5.0
    rewriter_enabled: bool = False
    rewriter_max_retries: int = 2
    rewriter_timeout_seconds: float = 30.0
    rewriter_concurrency: int = 3
    max_concurrent_sources: int = 3
    health_check_delay_seconds: float = 1.0
    probe_timeout_seconds: float = 15.0
    site_url: str = "https://example.com"
    digest_window_hours: float = 24.0
    digest_max_jobs: int = 5
    scrape_cron: str = ""
    health_check_cron: str = ""
    store_path: str = ""

    def max_pages(self, source: str, default: int) -> int:
        return {"jobfound": self.flat_max_pages, "talentd": self.graph_max_pages}.get(source, default)

    def crawl_delay(self, source: str, default: float) -> float:
        return {"jobfound": self.flat_crawl_delay_seconds, "talentd": self.graph_crawl_delay_seconds}.get(source, default)

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Settings:
        """Variables are the upper-case field names; blank ones are unset."""
        env = dict(os.environ) if env is None else env
        base, found = Settings(), {}
        for f in fields(Settings):
            raw = (env.get(f.name.upper()) or "").strip()
            if raw:
                kind = type(getattr(base, f.name))
                found[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return replace(base, **found)
