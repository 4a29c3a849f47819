"""Curating and measuring a stream of short documents, as Spark DataFrame jobs."""
