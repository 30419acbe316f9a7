"""annalist.sources."""
