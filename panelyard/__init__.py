"""Panel analytics as Spark jobs: bars, features, weights, accounts, evaluation and ledgers on long tables."""
