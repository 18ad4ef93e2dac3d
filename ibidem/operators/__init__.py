"""DataFrame operators: chunking, neighbours, joins, aggregation, retrieval, changes to tables."""
