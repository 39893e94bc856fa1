"""Registered queries: each pairs a Spark plan with the SQL that checks it."""
