"""Sources and sinks: scans, change feeds and the versioned table."""
