"""spanloom: interval-overlap analytics and large-table data processing on Spark."""

__version__ = "0.1.0"
