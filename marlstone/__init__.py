"""marlstone: document inventory, change tracking and retrieval analytics on Spark."""
