"""The catalogue of registered queries."""

from __future__ import annotations

from functools import partial

from tillworks.catalog import registry


def _load() -> None:
    from tillworks.catalog import modules  # noqa: F401


def queries():
    _load()
    return {key: partial(registry.run, key) for key in registry.PLANS}


def checks():
    _load()
    return dict(registry.CHECKS)
