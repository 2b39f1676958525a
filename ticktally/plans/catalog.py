"""All queries of the core with their SQL equivalents."""

from __future__ import annotations

from . import live, problems, reports

QUERIES = {n: getattr(problems, n) for n in ("p1_found", "p1_requests", "p1_timers", "p1_request_tags", "p1_schema", "p2_found", "p2_wide", "p3_found", "p3_stuck", "p3_impossible", "p4_found", "p4_shares")} | reports.QUERIES | live.QUERIES
ORACLES: dict[str, str] = dict(problems.ORACLES) | reports.ORACLES | live.ORACLES
