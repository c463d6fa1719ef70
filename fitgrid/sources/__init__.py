"""Readers and writers of labelled tables and result records, and a blob generator."""
