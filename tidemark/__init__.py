"""Retrieval, graph and activity analytics over document collections, expressed as Spark plans."""
