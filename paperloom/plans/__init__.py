"""Plans made of the operators: the document pipeline, rendered sample documents, and the query catalogue."""
