"""Tables, columns and what can be done with them."""
