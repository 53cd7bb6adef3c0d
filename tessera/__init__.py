"""tessera: extraction-and-scoring operators expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
