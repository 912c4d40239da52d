"""Readers that keep text as it is: delimited files, workbooks, file corpora, tables."""
