"""annalist.operators."""
