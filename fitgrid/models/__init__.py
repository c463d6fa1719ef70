"""Model training on DataFrames: closed forms of our own and MLlib estimators."""
