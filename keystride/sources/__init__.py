"""Reading and writing: query-count lines, event log, versioned dictionary, test views."""
