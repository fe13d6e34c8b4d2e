"""factloom: typed, verifiable facts from document-shaped tables, as Spark plans."""

__version__ = "0.1.0"
