"""Operations of a training-data pipeline. ``queries()`` and ``oracle_sql()`` collect what the modules register."""

from __future__ import annotations

from importlib import import_module

from marketloom.session import ship

MODULES = ("mixing", "packing", "warc", "templates", "toxicity", "quality", "suffix", "langid", "simhash", "topk", "spelling", "styletree", "hamerly")


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: _shipped(f) for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}
