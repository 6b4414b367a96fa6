"""Data-sized operators: DataFrame in, DataFrame or small counts out."""
