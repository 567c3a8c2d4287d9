"""Relational operators over findings, jobs, decisions and time series."""
