"""Replay of the update log, snapshots and comparison."""
