"""Column functions: timestamps, line formats, patterns."""
