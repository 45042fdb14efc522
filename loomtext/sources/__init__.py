"""loomtext.sources."""
