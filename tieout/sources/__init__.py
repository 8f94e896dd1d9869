"""Reading deliveries, recording their receipt, and writing them out again."""
