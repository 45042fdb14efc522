"""loomtext.functions."""
