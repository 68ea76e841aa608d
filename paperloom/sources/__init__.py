"""Readers: intake state, event log, traces, client lists, folders and the benchmark tables."""
