"""Every registered query: its Spark call and, where SQL can say it, the same result as DuckDB text."""

from importlib import import_module

from checks.base import Check

MODULES = ("fleet", "battery", "driving", "charging", "forecast", "quality", "align", "streams", "stored")


def all_checks(*modules: str) -> dict[str, Check]:
    found: dict[str, Check] = {}
    for module in modules or MODULES:
        for item in import_module(f"checks.{module}").CHECKS:
            if item.name in found:
                raise ValueError(f"query registered twice: {item.name}")
            found[item.name] = item
    return found
