"""Command logs and snapshots."""
