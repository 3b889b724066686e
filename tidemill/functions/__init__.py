"""Column functions: text, URLs, stream labels, progress lines, retries, statuses, cookies."""
