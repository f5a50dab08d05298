"""quire: document processing as DataFrames.

Files, pages, rasters, words, jobs, events and history are tables; cleaning, layout, encoding
and queue logic are DataFrame, SQL, Arrow and Structured Streaming operators over them.
"""

__version__ = "0.1.0"
