"""Structured Streaming: job dispatch and incremental rates."""
