"""Relational operators over the message model. Each takes and gives DataFrames and plans nothing by itself."""
