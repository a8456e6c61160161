"""All registered queries of the frame jobs and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

for _name in ("frames", "pixels", "sky", "files"):
    _plan = importlib.import_module(f"nightloom.plans.{_name}")
    QUERIES.update(_plan.QUERIES)
    ORACLE.update(_plan.ORACLE)
