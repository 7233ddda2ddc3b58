"""Training-data pipeline operators over `documents` and its sibling tables."""
