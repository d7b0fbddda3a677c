"""Column expressions: effect identifiers and the scalar functions of the model."""
