"""Entity-topic analytics on Spark: knowledge-base ETL, entity matching, topics, coherence and corpus operators as DataFrame functions."""

__version__ = "0.1.0"
