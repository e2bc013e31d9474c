"""spandrel: table and document comparison, expressed as Spark plans."""

__version__ = "0.1.0"
