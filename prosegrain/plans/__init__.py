"""Composed plans and the catalogue of registered queries."""

import importlib

_MODULES = ["loading", "text", "detection", "rolling", "profiles", "comparing", "detectors", "libraries", "incremental"]


def load_catalog():
    """Import every module that registers queries and return the catalogue."""
    for m in _MODULES:
        importlib.import_module(f"prosegrain.plans.{m}")
    return importlib.import_module("prosegrain.plans.catalog")
