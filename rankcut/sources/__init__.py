"""Readers and writers of the data sets."""
