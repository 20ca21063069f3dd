"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from loomtab.plans import records, reference


def flagship(spark, d):
    return reference.flagship(spark, d)


def all_queries() -> dict:
    return {**reference.Q, **records.QUERIES}


def all_oracles() -> dict:
    return {**reference.SQL, **records.ORACLE}
