"""Column functions: serialization, exact decimals, compressed sizes."""
