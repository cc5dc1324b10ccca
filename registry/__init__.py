"""Binding of the operators to the driver's tables, each with the SQL that must give the same rows."""

from importlib import import_module

MODULES = ["prices", "climate", "serving", "conforming", "quality", "sources", "landing", "modelling", "loading"]


def load_all():
    from registry import base

    for name in MODULES:
        import_module(f"registry.{name}")
    return base.QUERIES, base.ORACLE
