"""Text knowledge pipeline on Spark: DataFrame in, DataFrame out."""
