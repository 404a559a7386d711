"""permeon: permutation inference on mass-univariate linear models, on Apache Spark."""
