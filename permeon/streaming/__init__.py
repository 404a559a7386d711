"""Online p-values over streams of permutations."""
