"""Part of the retrieval engine; see the README for an overview."""
