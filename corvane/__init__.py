"""corvane: DataFrame operators for preparing and judging training corpora on Spark."""
