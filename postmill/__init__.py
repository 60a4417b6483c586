"""Job-postings analytics on Spark."""
