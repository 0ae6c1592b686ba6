"""Which files a time window needs, and whole runs."""
