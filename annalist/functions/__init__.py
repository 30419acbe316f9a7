"""annalist.functions."""
