"""crosspanel: cross-sectional factor research on (date, asset) panels, as Spark jobs."""

__version__ = "0.1.0"
