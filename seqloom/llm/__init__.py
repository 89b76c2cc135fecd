"""Training-data operators. Nothing else in seqloom imports this subpackage."""
