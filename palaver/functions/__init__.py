"""Column functions: text cleaning, masking, tokens, classification, scripts. No Python UDFs."""
