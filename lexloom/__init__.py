"""lexloom: versioned-text analytics as Spark DataFrame plans."""
