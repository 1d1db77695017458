"""Reports and snapshots."""
