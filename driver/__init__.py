"""How the operators are bound to the driver tables, and the SQL they are checked against."""
