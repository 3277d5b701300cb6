"""Inputs and outputs: event text files, stored event tables, change feeds, JDBC tables."""
