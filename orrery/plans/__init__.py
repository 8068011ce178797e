"""Query languages compiled to DataFrame plans: a vector SQL dialect, SPARQL and Cypher."""
