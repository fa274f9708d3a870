"""Reads over snapshots, entries and transactions: summaries, stacks, pages and exports."""
