"""Evidence, retrieval, knowledge-graph and formulation jobs as Spark DataFrame operators."""
