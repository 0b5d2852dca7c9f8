"""tesserae: block-sparse linear algebra and atomistic graphs as Spark DataFrames."""

__version__ = "0.1.0"
