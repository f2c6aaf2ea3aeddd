"""Column functions: text normalisation, quantities, vectors."""
