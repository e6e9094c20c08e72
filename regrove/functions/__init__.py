"""Numerical functions on the driver: Student's t, small linear algebra."""
