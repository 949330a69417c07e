"""Sources, sinks and snapshots."""
