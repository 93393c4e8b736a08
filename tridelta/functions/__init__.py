"""Column expressions and rank-sized driver algebra."""
