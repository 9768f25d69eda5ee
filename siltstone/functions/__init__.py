"""Column functions: native expressions first, Arrow UDFs only where none exists."""
