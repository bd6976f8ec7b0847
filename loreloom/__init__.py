"""Knowledge-corpus, retrieval and event-state jobs expressed as Spark plans."""

__version__ = "0.1.0"
