"""srclens: architectural smell analytics over source-code corpora, on Spark.

Source files are a table; parsers are re-expressed as DataFrame operators
(exploded lines and tokens, window functions, as-of and interval joins);
detectors are relational queries over the resulting fact tables.
"""

__version__ = "0.1.0"
