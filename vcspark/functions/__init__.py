"""Column functions; all are Catalyst expressions unless they say otherwise."""
