"""Every query by name, with the SQL that it is held against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("market", "windows", "cleaning", "joins", "scores", "texts", "insight", "demand", "models", "evidence", "pipeline", "streams")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"marketloom.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"marketloom.plans.{m}").SQL.items()}


def flagship(spark, sf_dir: str):
    return queries()["F7_segment_capacity"](spark, sf_dir)
