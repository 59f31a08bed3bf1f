"""Structured Streaming operators: topic source/sink, decode, dedup,
stateful insight counters, windowed revenue and streaming cleaning."""
