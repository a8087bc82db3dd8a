"""Structured Streaming: augmentation of micro-batches and mixtures that learn from a stream."""
