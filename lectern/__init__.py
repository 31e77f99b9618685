"""Retrieval, graph and text analytics over note collections, expressed as Spark plans."""
