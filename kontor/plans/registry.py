"""Collects the registered queries of every plan module."""

from __future__ import annotations

import importlib

PLAN_MODULES = ["kontor.plans.catalog", "kontor.plans.inventory_plans", "kontor.plans.ledger_plans",
                "kontor.plans.audit_plans", "kontor.plans.extra_plans"]


def _load():
    from kontor.plans import catalog
    for m in PLAN_MODULES:
        importlib.import_module(m)
    return catalog


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLE)
