"""Reading, writing, converting and describing stored tables.

Storage targets (local disks, object stores, databases through JDBC) are Spark's own: a path or a JDBC URL.
"""
