"""Registered queries: importing this package fills the registry."""

from . import audit, cases, evaluation, kb, policy, retrieval, routing, sources, streams  # noqa: F401
