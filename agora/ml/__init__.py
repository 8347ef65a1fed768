"""MLlib models: idea clusters, topics and success prediction."""
