"""Query and rewrite JSON documents in Spark by RFC 9535 paths."""
