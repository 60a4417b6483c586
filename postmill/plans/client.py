"""A client of the read interface, over a transport that the caller provides."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import quote, urlencode

#: URL to (status, body); raises OSError where the server can't be reached.
Send = Callable[[str], tuple[int, str]]


class ApiError(Exception):
    """The server can't be reached (status None) or answered with something else than success."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def query_string(params: dict[str, object]) -> str:
    """The set parameters, form-encoded, with a leading ``?``; null and blank ones are unset, false and 0 are not."""
    said = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in params.items() if v is not None and v != ""}
    return "?" + urlencode(said, safe="*").replace("~", "%7E") if said else ""


class Client:
    def __init__(self, send: Send, base_url: str = "http://127.0.0.1:8000"):
        self.send, self.base_url = send, base_url

    def _get(self, path: str, missing: bool = False):
        try:
            status, body = self.send(f"{self.base_url}{path}")
        except OSError as e:
            raise ApiError(f"{self.base_url} can't be reached") from e
        if missing and status == 404:
            return None
        if not 200 <= status < 300:
            raise ApiError(f"the server answered {status}", status)
        return json.loads(body)

    def jobs(self, **query) -> dict:
        return self._get(f"/jobs{query_string(query)}")

    def job(self, job_id: str) -> dict | None:
        """The job, or None where there is none of this id."""
        return self._get(f"/jobs/{quote(job_id, safe="!~*'()")}", missing=True)

    def digest(self, hours: float | None = None) -> dict:
        return self._get(f"/social/digest{query_string({'hours': hours})}")
