"""quillmesh: a document-knowledge analytics engine written for Spark."""
