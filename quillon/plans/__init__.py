"""Registered queries; importing the package registers all of them."""

from quillon.plans import audits, registry, suites  # noqa: F401
