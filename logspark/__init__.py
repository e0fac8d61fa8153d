"""Log and observability analytics as ordinary PySpark DataFrame functions."""
