"""Join and graph operators that Spark has no single primitive for, composed from DataFrame operations."""
