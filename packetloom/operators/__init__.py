"""Operators: DataFrame -> DataFrame functions with columns and limits as parameters."""
