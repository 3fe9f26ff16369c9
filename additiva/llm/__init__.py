"""Training-data operators: each module is one DataFrame-to-DataFrame operator with its registered query."""
