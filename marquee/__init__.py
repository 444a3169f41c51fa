"""Listings engine on PySpark: scans, text/date/hash functions, listing queries,
change capture, entity resolution, statistics and streaming, all as DataFrame plans."""
