"""rankloom: ranked retrieval and structural analytics over text, code and dialogues on Spark DataFrames."""

__version__ = "0.1.0"
