"""loomline: text-curation, retrieval and evaluation analytics as Spark plans."""

__version__ = "0.1.0"
