"""The file pipeline and the registered queries."""
