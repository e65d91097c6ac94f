"""Plans that chain operators from raw records to results."""
