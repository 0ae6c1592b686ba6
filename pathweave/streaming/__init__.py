"""The replay as a stateful stream."""
