"""Statuta: retrieval, corpus quality and answer evaluation over whole Spark tables."""
