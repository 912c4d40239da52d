"""Whole runs: estimates, gates, the run record, results, the command line."""
