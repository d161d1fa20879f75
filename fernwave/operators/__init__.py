"""Graph, spectral, ranking, scoring, feature, learned and circuit operators on DataFrames."""
