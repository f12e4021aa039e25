"""Multi-pass review ledgers as Spark tables: scan, sweep, fold, coverage, verdicts, scoring, reports."""

__version__ = "0.1.0"
