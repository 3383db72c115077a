"""Plans: the analysis chain and the query registry."""
