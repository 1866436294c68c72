"""Typed table models and a composable query pipeline, compiled to Spark DataFrames."""
