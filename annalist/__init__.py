"""annalist: transcript provenance analytics on PySpark."""
