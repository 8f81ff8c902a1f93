"""Command interpreter, routing and distributed ranking."""
