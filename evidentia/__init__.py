"""Evidence corpora on Spark: ingest, retrieval, routing, conversations, admission control."""
