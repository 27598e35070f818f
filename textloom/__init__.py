"""textloom: one-edit text search, completion and text-table processing as Spark plans."""

__version__ = "0.1.0"
