"""Privacy-preserving record linkage on PySpark: profile, encode, block, verify, evaluate."""
