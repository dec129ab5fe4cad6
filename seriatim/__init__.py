"""A PySpark engine for serialised reading: archives of posts in, scheduled deliveries out."""
