"""Readers and writers: corpora, result tables, bits and bytes."""
