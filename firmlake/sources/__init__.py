"""Readers and writers: archives, filings, index pages, tables and logs."""
