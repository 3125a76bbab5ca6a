"""Query catalog."""

from importlib import import_module

MODULES = ["text_plans", "markup_plans", "code_plans", "flow_plans", "project_plans", "bundle_plans"]


def load_catalog():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import CATALOG

    return CATALOG
