"""Live tracking of changed files."""
