"""Readers and writers of documents and ledgers."""
