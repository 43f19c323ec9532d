"""echoloom: near-duplicate detection over fingerprint sequences, written for Spark."""
