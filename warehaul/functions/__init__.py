"""Column functions, SQL functions and the fixed values they rest on."""
