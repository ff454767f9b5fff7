"""Readers and writers of graphs, documents, feeds and registries."""
