"""Sources, sinks and the versioned table store."""
