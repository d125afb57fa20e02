"""Building blocks of plans: written intermediate tables and range-sorted data."""
