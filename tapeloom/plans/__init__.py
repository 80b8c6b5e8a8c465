"""Registered queries, one module per operator family."""

from importlib import import_module

from tapeloom.plans.base import ORACLES, QUERIES

for _name in ("windows", "joins", "logs_in", "risk", "audits", "datasets", "analytics", "streams"):
    import_module(f"tapeloom.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
