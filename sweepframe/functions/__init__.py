"""Column helpers shared by the operators; none of them is a Python UDF."""
