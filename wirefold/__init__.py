"""wirefold: wiring analytics over fact tables, as Spark DataFrame jobs."""

__version__ = "0.1.0"
