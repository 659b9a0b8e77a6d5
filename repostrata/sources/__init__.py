"""Readers and writers: file trees, exported logs, tables and reports."""
