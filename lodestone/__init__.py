"""A knowledge compiler on Spark: documents -> fragments -> confident triples -> queries."""

__version__ = "0.1.0"
