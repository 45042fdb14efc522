"""loomtext.operators."""
