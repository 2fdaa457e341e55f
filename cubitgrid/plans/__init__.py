"""Settings, stages and whole runs."""
