"""Readers and writers of document tables and text segments."""
