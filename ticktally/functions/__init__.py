"""Column expressions of reports: tags, durations, histogram buckets."""
