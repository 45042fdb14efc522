"""loomtext.plans."""
