"""Job graph of the tables, and the questions answered from them."""
