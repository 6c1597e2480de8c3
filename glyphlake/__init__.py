"""glyphlake: noisy-text recognition and resolution operators as Spark DataFrames."""

__version__ = "0.1.0"
