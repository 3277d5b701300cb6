"""Continuous maintenance: the view store and the queries that fill it."""
