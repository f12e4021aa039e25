"""Expectation suites: tables in, violation rows out (empty = accepted)."""

from passledger.expect.core import accepted, row_violations  # noqa: F401
