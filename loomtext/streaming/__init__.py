"""loomtext.streaming."""
