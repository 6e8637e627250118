"""Readers and writers of ensemble summaries and run reports."""
