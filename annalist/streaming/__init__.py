"""annalist.streaming."""
