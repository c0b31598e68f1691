"""querygrove: analytics over corpora of SQL artefacts, as PySpark DataFrame jobs."""

__version__ = "0.1.0"
