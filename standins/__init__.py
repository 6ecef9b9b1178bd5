"""Stand-ins: the domain tables derived from the driver tables, queries and SQL oracles."""
