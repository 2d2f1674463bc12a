"""vigil: sensor-interval scoring and labelled-image analytics on Spark DataFrames.

Sub-packages
------------
sources    readers: driver tables, text lines (file / socket / Kafka), binary image records, image folders
functions  Column-expression builders (parsing, encoding, vector and image math) - all JVM-side
operators  DataFrame -> DataFrame operators (intervals, carry-forward, scoring, cutoffs, metrics, models)
plans      the registered queries and their DuckDB oracle SQL
streaming  Structured Streaming forms of the interval scorer and the image classifier
sinks      text / model / stream writers
"""

__version__ = "0.1.0"
