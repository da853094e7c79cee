"""Column functions: text normalisation, tokens and metrics; integer similarities."""
