"""Training of the models in ``llm/models``; run on a developer machine, not in queries."""
