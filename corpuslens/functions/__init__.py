"""Column functions: native Spark expressions unless stated otherwise."""
