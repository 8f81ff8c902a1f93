"""Structured Streaming: command fold, log sink, windowed sketches."""
