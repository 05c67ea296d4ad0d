"""Training-data operators. Nothing else in quarry imports this subpackage."""
