"""DataFrame operators: choosing streams, resuming and merging, progress, retries, results."""
