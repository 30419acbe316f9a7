"""annalist.plans."""
