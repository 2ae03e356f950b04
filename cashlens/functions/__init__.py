"""Column-level building blocks: numbers, time, text, hashes."""
