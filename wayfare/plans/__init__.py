"""How the operators are put together: the warehouse and the registered queries."""
