"""quarry: hybrid retrieval, ranking and graph analytics as plain DataFrame operators."""
